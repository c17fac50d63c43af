import hashlib
import zlib

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm.mpegaudio import crc16, header, parse, read_media, write, write_media

from .plain import DOC, ODD


def test_payloads_come_back_whole(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ODD], DOC + ", media int")
    media = write_media(docs)
    found = read_media(media).collect()
    want = []
    for k, t in ODD:
        raw = (t or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        want.append((str(k), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == sorted(want)
    stored = {(str(r["doc_id"]), hashlib.sha256(r["media"]).hexdigest(), len(r["media"])) for r in media.collect()}
    assert {(str(r["doc_id"]), r["media_sha256"], r["media_bytes"]) for r in found} == stored
    assert all(r["bad_checksums"] == 0 and r["skipped_bytes"] == 0 for r in found)


def test_payload_bytes_that_look_like_headers_do_no_harm():
    payload = (b"\xff\xfa\xe4\xc0" * 3000 + b"ID3\4\0\0\0\0\0\x20" * 500).ljust(18_240, b" ")
    s = parse(write(payload, len(payload)))
    assert b"".join(s.carried)[: len(payload)] == payload


def test_durations_and_offsets_are_exact():
    payload = bytes(np.random.default_rng(0).integers(0, 256, 192_000, dtype=np.uint8))
    raw = write(payload, len(payload))
    s = parse(raw)
    assert s.samples == 1152 * s.frames and s.kind == (1, 3, 48000) and s.table_frames == s.frames and s.table_bytes == s.frames * 0 + len(raw) - raw.index(b"\xff\xfa")
    assert len(s.seeks) == -(-s.samples // 48000) and all(raw[x : x + 2] == b"\xff\xfa" for x in s.seeks)
    assert [x for x in s.seeks] == sorted(s.seeks)


def test_the_reader_finds_frames_again_after_junk_and_counts_bad_checksums():
    payload = bytes(5760)
    raw = bytearray(write(payload, len(payload)))
    whole = parse(bytes(raw))
    first = whole.seeks[0]
    junk = parse(bytes(raw[:first]) + b"\xff\xfbjunk\xff" * 9 + bytes(raw[first:]))
    assert junk.frames == whole.frames and junk.skipped == 63
    raw[first + 8] ^= 1
    assert parse(bytes(raw)).bad_checksums == 1


def test_headers_of_every_kind():
    assert header(b"\xff\xfb\x90\x64").length == 417 and header(b"\xff\xfb\x92\x64").length == 418
    assert header(b"\xff\xf3\x40\xc4").version == 2 and header(b"\xff\xe3\x40\xc4").version == 2.5
    assert header(b"\xff\xfb\xf0\x64") is None and header(b"\xff\xfb\x9c\x64") is None and header(b"abcd") is None
    assert crc16(b"") == 0xFFFF


def test_tags_and_tables():
    frame = b"\xff\xfb\x90\x64" + bytes(413)
    vbri = frame[:36] + b"VBRI" + bytes([0, 1, 0, 0, 0, 0]) + (1234).to_bytes(4, "big") + (3).to_bytes(4, "big") + bytes(8) + frame[62:]
    tag = b"TAG" + b"A title".ljust(30, b"\0") + bytes(95)
    s = parse(vbri + frame * 3 + tag)
    assert (s.table, s.table_frames, s.table_bytes, s.frames, s.tags["ID3v1"]) == ("VBRI", 3, 1234, 3, "A title")


FRAME = b"\xff\xfb\x90\x64" + bytes(413)


def test_tags_that_are_cut_or_malformed_are_junk():
    for raw in (b"ID3\4\0\x40\0\0\x10\0", b"ID3\4\0\0\0\0\0\x14TIT2\0\0\0\x0a\0\0\3", b"ID3", b"ID3\3\0\0\x7f\x7f\x7f\x7f"):
        s = parse(raw)
        assert (s.frames, s.skipped, s.tags) == (0, len(raw), {})
    for junk in (b"an ID3 in a sentence, of any size", b"ID3\4\0\0\xff\0\0\0 junk", b"ID3\3\0\0\x7f\x7f\x7f\x7f beyond the end"):
        s = parse(FRAME * 3 + junk + FRAME * 5)
        assert s.frames == 8 and s.skipped == len(junk) and not s.tags
    assert parse(b"ID3\4\0\x40\0\0\0\2\0\0" + FRAME * 3).frames == 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"ID3", b"\4\0", b"\3\0\x40", b"\0\0\0\x20", b"TIT2", b"TXXX", b"\1\xff\xfe", b"TAG", b"Xing", b"VBRI", b"\xff\xfb\x90\x64", b"\xff\xfc\x94\x44", FRAME, FRAME[:200], bytes(40), b"x" * 130, b"\xff" * 9]), max_size=14).map(b"".join))
def test_no_bytes_end_the_reader(raw):
    s = parse(raw)
    assert s.frames >= 0 and s.skipped <= len(raw)


def test_a_lone_header_after_a_tag_does_not_fix_the_kind():
    tag = b"ID3\4\0\0\0\0\0\0"
    s = parse(tag + b"\xff\xf3\x40\xc4" + b"junk" * 100 + FRAME * 4)
    assert s.kind == (1, 3, 44100) and s.frames == 4


def test_a_vbri_table_is_read_to_its_end():
    head = bytes([0, 1, 0, 0, 0, 0]) + (1234).to_bytes(4, "big") + (3).to_bytes(4, "big")
    big = b"\xff\xfb\xe0\x64" + bytes(1040)
    table = big[:36] + b"VBRI" + head + (450).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + bytes(range(1, 226)) * 4
    s = parse(table.ljust(len(big), b"\0") + big * 3)
    assert s.toc == bytes(range(1, 226)) * 4 and s.frames == 3


def plain_crc(bits):
    x = 0xFFFF
    for b in bits:
        top = x >> 15 ^ b
        x = x << 1 & 0xFFFF
        x ^= 0x8005 if top else 0
    return x


# Subbands and widths of layer II allocations, written out: bitrate index, rate index, mode, bound, widths.
LAYER_2 = [
    (0xA, 1, 0b00, 27, [4] * 11 + [3] * 12 + [2] * 4, 2),
    (0xE, 0, 0b00, 30, [4] * 11 + [3] * 12 + [2] * 7, 2),
    (0x8, 0, 0b01, 4, [4] * 11 + [3] * 12 + [2] * 4, 2),
    (0x1, 0, 0b11, 8, [4] * 2 + [3] * 6, 1),
    (0x1, 2, 0b11, 12, [4] * 2 + [3] * 10, 1),
]


def test_checksums_of_layer_2():
    rng = np.random.default_rng(6)
    for rate_bits, rate, mode, bound, widths, channels in LAYER_2:
        head = bytes([0xFF, 0xFC, rate_bits << 4 | rate << 2, mode << 6])
        h = header(head)
        assert h.layer == 2 and h.protected
        frames = []
        for _ in range(3):
            allocation, more = [], 0
            for band, width in enumerate(widths):
                for _ in range(channels if band < bound else 1):
                    value = int(rng.integers(0, 1 << width)) * int(rng.integers(0, 2))
                    allocation += [value >> (width - 1 - k) & 1 for k in range(width)]
                    more += (2 if band < bound else 2 * channels) if value else 0
            bits = allocation + rng.integers(0, 2, more).tolist()
            checked = plain_crc([b >> (7 - k) & 1 for b in head[2:] for k in range(8)] + bits)
            body = np.packbits(np.array(bits, np.uint8)).tobytes()
            frames.append((head + checked.to_bytes(2, "big") + body).ljust(h.length, b"\0"))
        raw = b"".join(frames)
        s = parse(raw)
        assert (s.frames, s.checked, s.bad_checksums) == (3, 3, 0)
        bad = bytearray(raw)
        bad[h.length + 6] ^= 0x80
        assert parse(bytes(bad)).bad_checksums == 1


def test_media_without_frames_and_empty_tables(spark):
    found = read_media(spark.createDataFrame([(1, None), (2, bytearray(b"no audio"))], "doc_id long, media binary")).collect()
    assert [r["samples"] for r in found] == [0, 0]
    assert read_media(write_media(spark.createDataFrame([], DOC))).count() == 0


def test_payloads_with_tag_near_the_end_come_back_whole():
    for size in (192, 960, 1344):
        for at in range(max(0, size - 256), size - 2):
            payload = (b"x" * at + b"TAG").ljust(size, b"y")
            raw = write(payload, size)
            s = parse(raw)
            assert b"".join(s.carried)[:size] == payload and s.frames == s.table_frames and "ID3v1" not in s.tags
            s = parse(raw + b"TAG" + b"A title".ljust(125, b"\0"))
            assert b"".join(s.carried)[:size] == payload and s.frames == s.table_frames and s.tags["ID3v1"] == "A title"


def test_a_cut_frame_does_not_hide_the_tag_behind_it():
    raw = write(bytes(1920), 1920)
    s = parse(raw[:-50] + b"TAG" + b"A title".ljust(125, b"\0"))
    assert s.frames == s.table_frames - 1 and s.tags["ID3v1"] == "A title"
