"""MPEG audio columns: frame headers, tags, variable-bitrate tables, checksums, durations and seek offsets.

The reader takes any bytes: it skips ID3v2 tags and an ID3v1 tag where no frame lies, finds frames again after junk (a header counts
if a frame or a tag ends before it, or another header of its kind, a tag or the end follows its frame; the first one, which fixes the
kind, needs such a follower, a table or a checksum that holds), parses Xing, Info and VBRI tables, checks the CRC of protected frames
of every layer, and gives the duration in samples, the offset of the frame that holds each whole second, and the bytes that frames
carry behind their side information. A tag whose head is malformed, or that would reach beyond the end, is junk.

The writer stores any payload as a valid layer III stream: every frame is silent (its side information is zero), so its main
data is ancillary and holds payload bytes as they are. Sizes are those of 320 kbit/s but for the last frame, which has the
least bitrate that takes the rest; a Xing or Info frame leads, and ID3v2 text frames name the lengths.

Defined results: null text counts as empty; a payload is never empty (padding makes it 192 bytes at least); null or repeated
doc_ids return a row each; an empty table gives no rows; media without a frame has no samples; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks

UNIT = 192

# Fixed values of the format: kbit/s by (first version, layer), sample rates of the first version, side information bytes.
_KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = (44100, 48000, 32000)
# Also fixed: bits of a layer II allocation, as pairs of the subband behind the last and the bits of each up to it.
_HIGH_27, _HIGH_30 = ((11, 4), (23, 3), (27, 2)), ((11, 4), (23, 3), (30, 2))
_LOW_8, _LOW_12, _SECOND = ((2, 4), (8, 3)), ((2, 4), (12, 3)), ((4, 4), (11, 3), (30, 2))
_SIDE = {(True, True): 17, (True, False): 32, (False, True): 9, (False, False): 17}  # by (first version, mono)


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    joint: int
    length: int
    samples: int

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """What four bytes say, or None if they are no frame header (free-format ones aren't taken)."""
    if len(raw) < 4 or raw[0] != 255 or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = (2.5, None, 2, 1)[raw[1] >> 3 & 3], (None, 3, 2, 1)[raw[1] >> 1 & 3]
    bitrate, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer is None or bitrate in (0, 15) or rate == 3 or raw[3] & 3 == 2:
        return None
    first, padding = version == 1, raw[2] >> 1 & 1
    kbits, hertz = _KBITS[first, layer][bitrate], _RATES[rate] // (1 if first else 2 if version == 2 else 4)
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12000 * kbits // hertz + padding) * 4 if layer == 1 else samples * 125 * kbits // hertz + padding
    return Header(version, layer, not raw[1] & 1, kbits, hertz, raw[3] >> 6 == 3, raw[3] >> 4 & 3 if raw[3] >> 6 == 1 else -1, length, samples)


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        x = b << 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return out


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The checksum of protected frames, over whole bytes."""
    x, table = 0xFFFF, _crc_table()
    for b in data:
        x = (x << 8 & 0xFF00) ^ table[x >> 8 ^ b]
    return x


def _covered(h: Header) -> int | None:
    """Bytes behind the checksum that it covers; None for layer II, where they depend on the allocation."""
    if h.layer == 3:
        return _SIDE[h.version == 1, h.mono]
    if h.layer == 1:
        return 16 if h.mono else 32 if h.joint < 0 else (4 * (2 * 4 * (h.joint + 1) + 32 - 4 * (h.joint + 1))) // 8
    return None


def _allocation(h: Header) -> tuple[tuple[int, int], ...]:
    """The allocation table of a layer II frame."""
    each = h.kbits / (1 if h.mono else 2)
    if h.version != 1:
        return _SECOND
    if each <= 48:
        return _LOW_12 if h.rate == 32000 else _LOW_8
    return _HIGH_30 if h.rate != 48000 and each >= 96 else _HIGH_27


def _covered_bits(h: Header, body: bytes) -> int:
    """Bits of a layer II body that its checksum covers: the allocation, and two for each channel of a subband that has any."""
    bits, at, more, band = int.from_bytes(body, "big"), 0, 0, 0
    n, channels = 8 * len(body), 1 if h.mono else 2
    bound = 4 * (h.joint + 1) if h.joint >= 0 else 32
    for until, width in _allocation(h):
        for band in range(band, until):
            for _ in range(channels if band < bound else 1):
                at += width
                if at <= n and bits >> (n - at) & (1 << width) - 1:
                    more += 2 * (1 if band < bound else channels)
        band = until
    return at + more


def _sound(data: memoryview, at: int, h: Header, body: int) -> bool | None:
    """Whether a protected frame's checksum holds; None if what it covers doesn't lie in the frame."""
    stop = at + h.length
    if h.layer == 2:
        bits = _covered_bits(h, bytes(data[body : min(stop, body + 48)]))
        whole, rest = divmod(bits, 8)
        if body + -(-bits // 8) > stop:
            return None
    else:
        whole, rest = _covered(h), 0
        if body + whole > stop:
            return None
    x = crc16(bytes(data[at + 2 : at + 4]) + bytes(data[body : body + whole]))
    for k in range(rest):
        x = (x << 1 & 0xFFFF) ^ (0x8005 if (x >> 15 ^ data[body + whole] >> (7 - k)) & 1 else 0)
    return x == int.from_bytes(data[at + 4 : at + 6], "big")


@dataclass
class Stream:
    """What parse() finds."""

    kind: tuple | None = None
    channels: int = 0
    frames: int = 0
    samples: int = 0
    skipped: int = 0
    bad_checksums: int = 0
    checked: int = 0
    bitrates: set[int] = field(default_factory=set)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    tags: dict[str, str] = field(default_factory=dict)
    seeks: list[int] = field(default_factory=list)
    carried: list[memoryview] = field(default_factory=list)


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _tag_end(data: memoryview, at: int) -> int | None:
    """End of the ID3v2 tag at a position, or None if there is none."""
    if at + 10 > len(data) or data[at] != 73:
        return None
    head = bytes(data[at : at + 10])
    if head[:3] != b"ID3" or head[3] not in (2, 3, 4) or head[4] == 255 or max(head[6:]) > 127:
        return None
    end = at + 10 + _syncsafe(head[6:]) + 10 * (head[5] >> 4 & 1)
    return end if end <= len(data) else None


def _id3v2(data: memoryview, at: int, end: int, tags: dict[str, str]) -> None:
    """Takes the text frames of the tag at a position."""
    major, flags, x = data[at + 3], data[at + 5], at + 10
    if flags & 0x40 and x + 4 <= end:
        x += _syncsafe(data[x : x + 4]) if major == 4 else 4 + int.from_bytes(data[x : x + 4], "big")
    while major in (3, 4) and x + 10 <= end and data[x]:
        name = bytes(data[x : x + 4]).decode("latin-1")
        n = _syncsafe(data[x + 4 : x + 8]) if major == 4 else int.from_bytes(data[x + 4 : x + 8], "big")
        if name[:1] == "T" and n and x + 10 + n <= end:
            coding = ("latin-1", "utf-16", "utf-16-be", "utf-8")[min(3, data[x + 10])]
            text = bytes(data[x + 11 : x + 10 + n]).decode(coding, "replace").rstrip("\0")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            tags[name] = text
        x += 10 + n


def _table(data: memoryview, at: int, h: Header, out: Stream) -> bool:
    """Parses the variable-bitrate table of the frame at a position, if it has one."""
    x = at + 4 + 2 * h.protected + _SIDE[h.version == 1, h.mono]
    name = bytes(data[x : x + 4])
    if name in (b"Xing", b"Info") and x + 8 <= len(data):
        flags, x = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        if flags & 1:
            out.table_frames, x = int.from_bytes(data[x : x + 4], "big"), x + 4
        if flags & 2:
            out.table_bytes, x = int.from_bytes(data[x : x + 4], "big"), x + 4
        if flags & 4:
            out.toc = bytes(data[x : x + 100])
    elif bytes(data[at + 36 : at + 40]) == b"VBRI" and at + 62 <= len(data):
        name, out.table_bytes, out.table_frames = b"VBRI", *struct.unpack_from(">II", data, at + 46)
        entries, scale, width, _ = struct.unpack_from(">HHHH", data, at + 54)
        out.toc = bytes(data[at + 62 : min(at + h.length, at + 62 + entries * width)])
    else:
        return False
    out.table = name.decode()
    return True


def parse(raw: bytes) -> Stream:
    """Everything in a byte string that may hold MPEG audio."""
    data, out = memoryview(raw), Stream()
    end, at, second, synced = len(data), 0, 0, -1  # synced: where a frame or a tag has ended
    last = end - 128 if end >= 128 and bytes(data[-128:-125]) == b"TAG" else end  # an ID3v1 tag, unless a frame covers it
    while at < end:
        if at == last:
            out.tags["ID3v1"] = bytes(data[last + 3 : last + 33]).decode("latin-1").rstrip("\0 ")
            break
        if (stop := _tag_end(data, at)) is not None:
            _id3v2(data, at, stop, out.tags)
            at = synced = stop
            continue
        h = header(bytes(data[at : at + 4]))
        if h is not None and at + h.length <= end and (out.kind in (None, h.kind)):
            after = at + h.length
            following = header(bytes(data[after : after + 4])) if after + 4 <= end else None
            follows = following is not None and following.kind == h.kind
            # A frame over the place of an ID3v1 tag must be followed by another, or end the stream where one is due.
            covers = at < last < after
            follows = follows or not covers and (after in (last, end) or _tag_end(data, after) is not None)
            body, covered = at + 4 + 2 * h.protected, _covered(h)
            sound = _sound(data, at, h, body) if h.protected and (follows or at == synced) else None
            begins = at == synced and (out.kind is not None or sound or h.layer == 3 and _table(data, at, h, Stream()))
            if follows or begins and (not covers or after == end):
                synced = after
                if sound is not None:
                    out.checked += 1
                    out.bad_checksums += not sound
                if out.kind is None:
                    out.kind, out.channels = h.kind, 2 - h.mono
                    if h.layer == 3 and _table(data, at, h, out):
                        at = after
                        continue
                while second * h.rate < out.samples + h.samples:
                    out.seeks.append(at)
                    second += 1
                out.frames += 1
                out.samples += h.samples
                out.bitrates.add(h.kbits)
                out.carried.append(data[body + (covered or 0) : after])
                at = after
                continue
        found = raw.find(b"\xff", at + 1, end)
        tag = raw.find(b"ID3", at + 1, found if found >= 0 else end)
        to = tag if tag >= 0 else found if found >= 0 else end
        to = last if at < last < to else to
        out.skipped += to - at
        at = to
    return out


_MONO_48K = 0xC0
_SIDE_BYTES = _SIDE[True, True]
_FULL = 14  # index of 320 kbit/s


def _frame_head(bitrate: int) -> bytes:
    """Header, checksum and zero side information of a protected silent mono frame at 48 kHz."""
    tail = bytes([bitrate << 4 | 1 << 2, _MONO_48K])
    return b"\xff\xfa" + tail + crc16(tail + bytes(_SIDE_BYTES)).to_bytes(2, "big") + bytes(_SIDE_BYTES)


def _text_frame(name: bytes, text: bytes) -> bytes:
    return name + _safe(len(text) + 1) + b"\0\0\3" + text


def _safe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def write(payload: bytes, n_bytes: int) -> bytes:
    """A layer III stream that carries payload; n_bytes is noted in its tag."""
    sizes = [3 * x for x in _KBITS[True, 3]]
    head = {x: _frame_head(x) for x in range(1, _FULL + 1)}
    over = len(head[_FULL])
    room = sizes[_FULL] - over
    n, rest = divmod(len(payload), room)
    frames = np.zeros((n, sizes[_FULL]), np.uint8)
    frames[:, :over] = np.frombuffer(head[_FULL], np.uint8)
    frames[:, over:] = np.frombuffer(payload, np.uint8, n * room).reshape(n, room)
    last = b""
    if rest:
        k = next(x for x in range(1, _FULL + 1) if sizes[x] - over >= rest)
        last = (head[k] + payload[n * room :]).ljust(sizes[k], b"\0")
    count, lead = n + bool(rest), sizes[9]
    total = lead + frames.size + len(last)
    toc = bytes(min(255, 256 * (lead + min(count * x // 100, n) * sizes[_FULL]) // total) for x in range(100))
    table = (b"Xing" if rest and n else b"Info") + struct.pack(">III", 7, count, total) + toc
    tag = _text_frame(b"TLEN", str(count * 24).encode()) + _text_frame(b"TXXX", b"payload_bytes\0" + str(len(payload)).encode()) + _text_frame(b"TXXX", b"n_bytes\0" + str(n_bytes).encode())
    return b"ID3\4\0\0" + _safe(len(tag)) + tag + (head[9] + table).ljust(lead, b"\0") + frames.tobytes() + last


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary) of docs (doc_id, text): the text's bytes, padded with spaces, as an MPEG stream."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_blocks(batch):
                media = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    media.append(write(data[a:b].tobytes().ljust(max(1, -(-(b - a) // UNIT)) * UNIT), b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(media)), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, media binary")


def _noted(s: Stream, name: str, otherwise: int) -> int:
    """The number that a tag notes."""
    noted = s.tags.get(name, "")
    return int(noted) if noted.isascii() and noted.isdigit() and len(noted) < 19 else otherwise


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, samples long, sample_rate long, frames long, bad_checksums long, skipped_bytes long, seek_offsets array<long>"


def read_media(media: DataFrame) -> DataFrame:
    """Per row of media (doc_id, media): the payload's digests, duration in samples, checks, and seek_offsets (one a second)."""

    def row(doc_id: int | None, raw: bytes | None) -> tuple:
        raw = raw or b""
        s = parse(raw)
        carried = b"".join(s.carried)
        payload = carried[: _noted(s, "payload_bytes", len(carried))]
        version, layer, rate = s.kind or (0, 0, 0)
        seeks = zlib.crc32(np.array(s.seeks, "<i8").tobytes())
        feature = f"mpeg{version:g}-{layer};{rate};{s.channels};frames={s.frames};samples={s.samples};{s.table or 'none'}={s.table_frames};kbits={min(s.bitrates, default=0)}-{max(s.bitrates, default=0)};crc={s.checked - s.bad_checksums}/{s.checked};seeks={len(s.seeks)}:{seeks:08x}"
        return doc_id, _noted(s, "n_bytes", len(payload)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, s.samples, rate, s.frames, s.bad_checksums, s.skipped, s.seeks

    kinds = [pa.string() if "string" in x else pa.list_(pa.int64()) if "array" in x else pa.int64() for x in _READ.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                part = batch.slice(x, 256)
                out = [row(k, m.as_py()) for k, m in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

    return media.select("doc_id", "media").mapInArrow(rows, _READ)
