"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache

import public_tokenizers
import xxhash

DOC = "doc_id long, text string"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

# Rows that every operator must take: null and blank texts, null and repeated ids, repeated rows, one long text.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank."),
    (6, "The quick brown fox jumps over the lazy dog near the river bank."),
    (6, "The quick brown fox jumps over the lazy dog near the river bank."),
    (6, "Étude für Elise — 音楽 \U0001f600 naïve café."),
    (None, "a row without a name"),
    (None, None),
    (7, "word " * 40_000),
    (8, "x" * 50_000),
    (9, "<|endoftext|> is plain text, ▁ too"),
]


@lru_cache(maxsize=1)
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return t


def ids(text: str | None, end: int) -> list[int]:
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, end]


def crc(values: list[int]) -> int:
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in values))


def simhash(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], threshold: int = 4) -> list[int]:
    """For each print the least index that it reaches."""
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(prints))]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def spans(text: str) -> list[tuple[str, int, int]]:
    def digits(x):
        return re.sub("[^0-9]", "", x)

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(n))
