import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestream.llm.toolcalls import canonical, conforms, levels, link, linked_chats

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
CHAT = "conv_id long, turn long, role string, text string"
SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "number", "minimum": 0}, "how": {"enum": ["fast", "slow"]}, "xs": {"type": "array", "items": {"type": "string", "maxLength": 2}}}, "required": ["a"], "additionalProperties": False}}


def test_calls_meet_their_results(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, "x", "add", '{"b": 2, "a": 1}', []),
            (1, 3, "y", "add", '{"a": "1"}', ["x"]),
            (1, 5, "z", "other", '{"a": 1}', ["y", "x", "gone"]),
            (1, 5, "z", "other", '{"a": 1}', ["y", "x", "gone"]),
            (2, 1, "x", "add", "not json", None),
            (None, 1, "x", "add", '{"a": 1}', []),
            (3, 1, None, "add", None, []),
        ],
        CALLS,
    )
    results = spark.createDataFrame([(1, 2, "x", "3"), (1, 4, "y", None), (1, 2, "x", "4"), (2, 9, "lost", "?"), (None, 2, "x", "no")], RESULTS)
    found = link(calls, results, SCHEMAS).collect()
    assert len(found) == 12
    by = {(r["conv_id"], r["kind"], r["call_id"], r["message"]): r for r in found}
    x = next(r for k, r in by.items() if k[:3] == (1, "call", "x"))
    assert x["linked"] and x["valid"] and x["level"] == 0
    assert x["message"] == '{"arguments":{"a":1,"b":2},"id":"x","name":"add","result":{"content":"3","turn":2},"role":"assistant"}'
    y = next(r for k, r in by.items() if k[:3] == (1, "call", "y"))
    assert y["linked"] and not y["valid"] and y["level"] == 1
    z = next(r for k, r in by.items() if k[:3] == (1, "call", "z"))
    assert not z["linked"] and not z["valid"] and z["level"] == 2
    assert next(r for k, r in by.items() if k[:3] == (1, "result", "y"))["level"] == 2
    lost = next(r for k, r in by.items() if k[:3] == (2, "result", "lost"))
    assert not lost["linked"] and lost["level"] is None and lost["valid"] is None
    assert json.loads(next(r for k, r in by.items() if k[:3] == (2, "call", "x"))["message"])["arguments"] is None
    assert not any(r["linked"] for r in found if r["conv_id"] is None)


def test_levels_of_chains_and_cycles(spark):
    rows = [(1, f"c{k}", [f"c{k - 1}"] if k else []) for k in range(6)] + [(2, "a", ["b"]), (2, "b", ["a"]), (2, "c", ["b"]), (2, "d", [])]
    found = {(r["conv_id"], r["call_id"]): r["level"] for r in levels(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")).collect()}
    assert found == {(1, f"c{k}"): k for k in range(6)} | {(2, "d"): 0}


def test_both_ways_give_the_same_levels(spark):
    rng = random.Random(3)
    rows = [(c, f"c{k}", rng.choices([*(f"c{j}" for j in range(max(0, k - 4), k + (k % 9 == 8) + 1) if j != k), "gone", None], k=rng.randint(0, 3))) for c in range(4) for k in range(60)]
    rows += rows[:10] + [(0, "c5", None), (None, "c1", ["c0"]), (1, None, ["c0"])]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")
    want, names = {}, {}
    for c, call, after in rows:
        if c is not None and call is not None:
            names.setdefault(c, {}).setdefault(call, set()).update(x for x in after or [] if x is not None)
    for c, own in names.items():
        done = {}
        for _ in range(len(own)):
            for call, after in own.items():
                known = [x for x in after if x in own]
                if call not in done and all(x in done for x in known):
                    done[call] = 1 + max((done[x] for x in known), default=-1)
        want |= {(c, call): n for call, n in done.items()}
    for together in (1 << 16, 100, 0):
        found = [tuple(r) for r in levels(calls, together).collect()]
        assert len(found) == len(want) and {(c, call): n for c, call, n in found} == want


def test_arguments_that_are_no_json(spark):
    deep, long = "[" * 200_000 + "]" * 200_000, "x" * 200_000
    arguments = ['{"a":"\\ud800"}', f'{{"a":{deep}}}', '{"a":NaN}', '{"a":1e999}', '{"a":-Infinity}', json.dumps({"a": 1, "long": long}), f'{{"a":1,"xs":{"[" * 900}{"]" * 900}}}']
    calls = spark.createDataFrame([(1, k, f"c{k}", "add", x, None) for k, x in enumerate(arguments)], CALLS)
    found = {r["turn"]: r for r in link(calls, spark.createDataFrame([], RESULTS), SCHEMAS).collect()}
    assert len(found) == len(arguments) and not any(r["valid"] for r in found.values())
    assert all(json.loads(found[k]["message"])["arguments"] is None for k in range(5))
    assert json.loads(found[5]["message"])["arguments"]["long"] == long


@pytest.mark.parametrize(
    "value,right",
    [({"a": 1}, True), ({"a": True}, False), ({"a": 1.0}, True), ({"a": 1.5}, False), ({}, False), ({"a": 1, "c": 2}, False), ({"a": 1, "b": -1}, False), ({"a": 1, "how": "fast"}, True), ({"a": 1, "how": 3}, False), ({"a": 1, "xs": ["ab"]}, True), ({"a": 1, "xs": ["abc"]}, False), ([], False), (None, False)],
)
def test_schemas(value, right):
    assert conforms(value, SCHEMAS["add"]) is right


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=12))
def test_canonical_json_is_one_text_for_one_value(value):
    text = canonical(value)
    assert json.loads(text) == value and canonical(json.loads(text)) == text


def test_plain_chats(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi \"é\"\n"), (1, 2, "assistant", "yo"), (1, 3, "User ", ""), (1, 4, "tool", None), (None, 0, "user", "x"), (2, 5, "assistant", "alone"), (1, 1, "user", "again"), (3, None, None, None)]
    found = linked_chats(spark.createDataFrame([(*r, True) for r in rows], CHAT + ", linked boolean")).collect()
    assert len(found) == len(rows)
    calls = sorted((r["turn"], r["valid"], r["level"], r["linked"]) for r in found if r["kind"] == "call")
    assert calls == [(1, True, 0, True), (1, True, 0, True), (3, False, 1, False)]
    assert [(r["call_id"], r["linked"]) for r in found if r["kind"] == "result" and r["conv_id"] == 2] == [("call:2:4", False)]
    assert sum(r["kind"] == "message" for r in found) == 4


def test_a_long_turn_is_kept_whole(spark):
    text = "é" * 300_000
    found = linked_chats(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], CHAT)).collect()
    assert {r["kind"] for r in found} == {"call", "result"} and all(text in r["message"] and r["linked"] for r in found)


def test_empty_table(spark):
    assert linked_chats(spark.createDataFrame([], CHAT)).count() == 0
