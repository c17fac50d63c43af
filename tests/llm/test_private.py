import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm.private import _term_hash, base_spans, disclosing_terms, sanitiser

from .plain import DOC, ODD, prose
from .plain import spans as plain_spans

PIECES = st.sampled_from(["a@b.c", "@", ".", "-", "+", " ", "4", "42", "1.2.3.4", "255.255", "300", "(", ")", "4111 1111 1111 1111", "4111-1111-1111-1111-", "+1 (555) 123-4567", "x", "é", "\n", "%", "mail", ".com", "00"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert base_spans(text) == plain_spans(text)


def planted():
    rows = [(300 + k, f"{prose(k, 30)} please write to Zorblat at anna.kern@example.org about {prose(1000 + k, 30)}") for k in range(40)]
    return rows + [(100 + k, prose(50 + k, 60) + " Zorblat is away") for k in range(3)] + [(200, "card 4111 1111 1111 1111, ip 10.0.0.1 and +1 (555) 123-4567")]


def test_counts_digests_and_terms(spark):
    rows = ODD + planted()
    docs = spark.createDataFrame([(*r, "s") for r in rows], DOC + ", spans string")
    found = sanitiser(docs).spans(docs).collect()
    want = sorted((str(k), hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in plain_spans(t or "")).encode()).hexdigest()) for k, t in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in found) == want
    one = next(r for r in found if r["doc_id"] == 200)
    assert (one["n_email"], one["n_ip"], one["n_card"], one["n_phone"]) == (0, 1, 1, 1)
    assert all("term:" in r["spans"] for r in found if r["doc_id"] in (100, 101, 102))
    assert not any("term:" in r["spans"] for r in found if r["doc_id"] in (4, 5))


def test_sanitised_texts_hold_neither_data_nor_what_discloses_it(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 9) for r in ODD + planted()], DOC + ", n_chars int, found int")
    out = sanitiser(docs).sanitise(docs)
    assert out.columns == docs.columns
    texts = {(r["doc_id"], r["n_chars"]): r["text"] for r in out.collect()}
    assert len(out.collect()) == docs.count()
    for (_, n), text in texts.items():
        assert text is None or "anna.kern" not in text and "Zorblat" not in text and len(text) == n
    assert (5, 64) in texts and texts[5, 64].startswith("The quick")


def plain_disclosure(texts, least=0.9, support=3, near=8):
    """Disclosure of each term that reaches least, by counts over all words of all texts."""
    words, total = [], 0
    for text in texts:
        own = [(m.start(), m.end(), m[0].casefold()) for m in re.finditer(r"\w+", text or "")]
        found = plain_spans(text or "")
        free = [w for w in own if not any(a < w[1] and b > w[0] for _, a, b in found)]
        words.append(([w[2] for w in free], [w[0] for w in free], [(f"{k}:{(text or '')[a:b].lower()}", a) for k, a, b in found]))
        total += len(free)
    occurs = Counter(w for own, _, _ in words for w in own)
    best = {}
    for entity in {e for _, _, m in words for e, _ in m}:
        mentions = mass = 0
        once, close, both, contexts = {}, Counter(), Counter(), {}
        for text, (own, starts, found) in zip(texts, words):
            at = [a for e, a in found if e == entity]
            if not at:
                continue
            mentions, mass, once[text] = mentions + len(at), mass + len(own), len(at)
            places = sorted({bisect_left(starts, a) for a in at})
            for k, w in enumerate(own):
                gap, p = min((k - p if p <= k else p - 1 - k, p) for p in places)
                both[w] += 1
                close[w] += gap < near
                about = tuple(own[min(max(p - near, 0), k) : max(min(p + near, len(own)), k + 1)])
                kept = contexts.setdefault(w, {})
                kept.setdefault((p, text), []).append((gap, about, gap < near))
        if sum(once.values()) < support:
            continue
        seen = {}
        for w, by_place in contexts.items():
            for each in by_place.values():
                about = min(each)[1]  # of a mention's occurrences the nearest gives the context
                seen.setdefault(w, {})[about] = seen.get(w, {}).get(about, False) or any(n for _, _, n in each)
        beside = {w: sum(x.values()) for w, x in seen.items() if len(x) >= support}
        neighbours = max((close[w] for w, n in beside.items() if n >= support), default=0)
        contexts_of = seen
        for w, n in beside.items():
            def share(joint, m, n, places):
                bits, hidden = math.log2(total / m), math.log2(max(occurs[w] / joint, 1)) if joint else 0.0
                sound = joint and bits > 0 and n >= support and n * math.log2(total / places) >= math.log2(total) + 10 and hidden <= 1
                return 1 - hidden / bits if sound else 0.0
            own = max(share(close[w], max(mentions, neighbours), n, min(16 * mentions, mass)), share(both[w], mass, len(contexts_of[w]), mass))
            best[w] = max(best.get(w, 0.0), own)
    return {w: round(x, 9) for w, x in best.items() if round(x, 9) >= least}


def test_disclosure_is_that_of_plain_counts(spark):
    rng, rows = random.Random(9), planted()
    for k in range(60):
        who = ["Marrow", "Quindle", "Vast"][k % 3]
        words = prose(9000 + k, 70).split()
        words.insert(rng.randrange(70), who if rng.random() < 0.9 else "other")
        words.insert(rng.randrange(70), f"{who.lower()}{k % 2}@example.org" if rng.random() < 0.8 else "+1 555 123 4567")
        rows.append((1000 + k, " ".join(words)))
    rows += rows[-7:] + [(2000, "Marrow said nothing"), (2001, None), (2002, "")]
    want = plain_disclosure([t for _, t in rows])
    found = {r["hash"]: r["disclosure"] for r in disclosing_terms(spark.createDataFrame(rows, DOC)).collect()}
    assert len(want) > 3 and "zorblat" in want
    hashes = dict(zip(want, _term_hash(list(want)).view("int64").tolist()))
    assert found.keys() == set(hashes.values())
    for w, h in hashes.items():
        assert abs(found[h] - want[w]) < 1e-8, w


def test_secrets_are_protected_but_no_base_spans(spark):
    rows = [(1, 'set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here'), (2, "PASSWORD=7695f98391c04c2f5d und"), (3, "the token: something else entirely"), (4, "a token of 12345678 and password: abc12"), (5, "api_key: 'Zk9-long/Value=='; mail a@b.c")]
    docs = spark.createDataFrame(rows, DOC)
    found = {r["doc_id"]: r for r in sanitiser(docs).spans(docs).collect()}
    assert [found[k]["spans"] for k in range(1, 6)] == ["secret:13:53", "secret:9:27", "", "", "email:34:39,secret:10:26"]
    assert [(found[k]["n_secret"], found[k]["n_spans"]) for k in range(1, 6)] == [(1, 1), (1, 1), (0, 0), (0, 0), (1, 2)]
    for k, t in rows:
        assert found[k]["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in plain_spans(t)).encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] for r in sanitiser(docs).sanitise(docs).collect()}
    assert texts[1] == 'set token = "[SECRET]" here' and texts[2] == "PASSWORD=[SECRET] und" and texts[4] == rows[3][1]


def test_terms_beyond_the_broadcast_are_joined(spark, monkeypatch):
    from lodestream.llm import private

    docs = spark.createDataFrame(ODD + planted(), DOC)
    wide = spark.createDataFrame([(*r, "k", "f", "t") for r in ODD + planted()], DOC + ", key string, Found string, found_key string")
    direct, texts = sorted(map(str, sanitiser(docs).spans(docs).collect())), sorted(map(str, sanitiser(docs).sanitise(wide).collect()))
    monkeypatch.setattr(private, "BROADCAST_TERMS", 0)
    assert sorted(map(str, sanitiser(docs).spans(docs).collect())) == direct
    out = sanitiser(docs).sanitise(wide)
    assert out.columns == wide.columns and sorted(map(str, out.collect())) == texts


def test_empty_table(spark):
    none = spark.createDataFrame([], DOC)
    assert sanitiser(none).spans(none).count() == 0


def test_terms_end_at_typographic_marks_and_in_scripts_without_spaces(spark):
    rows = planted() + [(500 + k, f"{prose(2000 + k, 30)} 请联系王小明 wang@example.org {prose(3000 + k, 30)}") for k in range(6)]
    odd = ["a “Zorblat” b", "a Zorblat’s b", "a Zorblat—who b", "a Zorblat…b", "ZOR­BLAT", "昨日Zorblat来", "昨天王小明来了，"]
    docs = spark.createDataFrame(rows + [(900 + k, t) for k, t in enumerate(odd)], DOC)
    own = sanitiser(docs)
    texts = {r["doc_id"]: r["text"] for r in own.sanitise(docs).collect()}
    assert not any("zorblat" in texts[900 + k].replace("­", "").lower() for k in range(6))
    assert "王小明" not in texts[906] and texts[906].startswith("昨天") and texts[906].endswith("来了，")
    spans = {r["doc_id"]: r["spans"] for r in own.spans(docs).collect()}
    assert spans[900] == "term:3:10" and spans[902] == "term:2:9" and spans[906] == "term:2:5"


def test_short_terms_and_numbers_are_judged_like_others(spark):
    rows = planted() + [(600 + k, f"{prose(4000 + k, 30)} ask Li of account 48213 at desk@example.org today {prose(5000 + k, 30)}") for k in range(6)]
    docs = spark.createDataFrame([*rows, (910, "a note by Li on 48213")], DOC)
    own = sanitiser(docs)
    spans = {r["doc_id"]: r["spans"] for r in own.spans(docs).collect()}
    assert spans[910].endswith("term:10:12,term:16:21")
    text = {r["doc_id"]: r["text"] for r in own.sanitise(docs).collect()}[910]
    assert "Li" not in text and "48213" not in text


def test_terms_far_from_the_mention_are_counted(spark):
    far = [(700 + k, f"Quindle Vast {prose(6000 + k, 120)} {prose(7000 + k, 120)} signed desk@example.org") for k in range(6)]
    one = [(720 + k, f"Marrow {prose(8000, 60)} copied mark@example.org {prose(8000, 40)}") for k in range(6)]
    docs = spark.createDataFrame([*ODD, *planted(), *far, *one, (920, "Quindle stays away, Marrow too")], DOC)
    own = sanitiser(docs)
    spans = {r["doc_id"]: r["spans"] for r in own.spans(docs).collect()}
    assert spans[920] == "term:0:7"
    texts = {r["doc_id"]: r["text"] for r in own.sanitise(docs).collect()}
    assert not any("Quindle" in (t or "") for t in texts.values()) and "Marrow" in texts[920]


def test_terms_inside_entities_do_not_lower_a_disclosure(spark):
    rows = planted() + [(600 + k, f"{prose(4000 + k, 30)} ask Li at li.w@example.org today {prose(5000 + k, 30)}") for k in range(6)]
    docs = spark.createDataFrame([*rows, (910, "a note by Li")], DOC)
    assert {r["doc_id"]: r["spans"] for r in sanitiser(docs).spans(docs).collect()}[910].endswith("term:10:12")


def test_names_beside_one_address_are_found_and_those_beside_many_are_not(spark):
    """40 people in 5 texts each with their own address, 40 other names in 5 texts each with addresses of many, over real rows."""
    rng = random.Random(12)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    letters = "bcdfghklmnprstvz"
    names = ["".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(4)).capitalize() for _ in range(80)]
    assert len(set(names)) == 80
    people, others, at = names[:40], names[40:], 1_000_000
    for k, name in enumerate(names):
        for c in range(5):
            address = f"person{k if k < 40 else rng.randrange(40, 80)}@example.org" if rng.random() < 0.9 else "desk@example.org"
            middle = prose(at, rng.choice([2, 5, 30]))
            rows.append((at, f"{prose(at + 1, 40)} {name} {middle} {address} {prose(at + 2, 40)}"))
            at += 3
    docs = spark.createDataFrame(rows, DOC)
    found = {r["hash"] for r in disclosing_terms(docs).collect()}
    hashes = dict(zip(names, _term_hash([x.casefold() for x in names]).view("int64").tolist()))
    right, wrong = sum(hashes[x] in found for x in people), sum(hashes[x] in found for x in others)
    assert right >= 38 and wrong <= 1
    words = {w.casefold() for _, t in rows[:1000] for w in re.findall(r"\w+", t or "")}
    common = sum(h in found for h in _term_hash(sorted(words)).view("int64").tolist())
    assert common <= len(words) * 1e-3
