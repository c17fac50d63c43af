"""Tool-call linking for chats.

Calls and results meet in a hash join by conversation and identifier; a call's level is one above the calls that it names as
dependencies and a result's one above its call, so that (conversation, level, turn) is a topological order; arguments are checked
against the tool's schema; and each message is serialised as canonical JSON (sorted keys, no spaces, only what must be escaped).

Chats without calls of their own are read by pairs: a user turn is a call of the tool `respond`, which the assistant's next turn
answers, and which depends on the conversation's first call as its context.

Levels of a conversation with at most TOGETHER calls are found in one pass over its calls; larger ones go by joins, a round for each
link of their longest chain.

Defined results: repeated call or result rows return a row each, and a call links to the least result of its identifier, so no
group multiplies; a call that nothing answers, a result without a call and a call that names no known tool are kept and marked; a
dependency that doesn't exist counts for nothing; calls in or behind a cycle have a null level; null text is null content (as an
argument it is invalid); arguments that aren't a JSON object of finite numbers and whole characters, or are nested too deeply to
read, are invalid and written as null; messages of null conversations link to nothing; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, store

#: The schema of the tool that turns of plain chats are read as calls of.
RESPOND = {
    "respond": {
        "type": "object",
        "properties": {"context": {"type": "string"}, "prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    }
}
#: Calls of a conversation that are ordered in one task's memory.
TOGETHER = 1 << 16
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    """value as JSON with sorted keys and no spaces; what isn't a finite number is refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _read(arguments: str | None) -> tuple[object, str]:
    """A JSON text's value and that value as canonical JSON, which UTF-8 can hold; null if there is none."""
    try:
        value = json.loads(arguments or "")
        text = canonical(value)
        text.encode()
        return value, text
    except (ValueError, RecursionError):  # also lone surrogates
        return None, "null"


def conforms(value: object, schema: dict) -> bool:
    """Whether value fits schema: type, enum, required, properties, additionalProperties, items and the bounds of each type."""
    if not schema:
        return True
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    is_kind = {k: isinstance(value, t) for k, t in _TYPES.items()} | {"number": number, "integer": number and value == int(value)}
    if kinds and not any(is_kind.get(k, False) for k in kinds):
        return False
    if "enum" in schema and not any(type(value) is type(x) and value == x for x in schema["enum"]):
        return False
    if number and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        return False
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        return False
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            return False
        return all(conforms(x, schema.get("items", {})) for x in value)
    if isinstance(value, dict):
        own = schema.get("properties", {})
        extra = schema.get("additionalProperties", True)
        if any(k not in value for k in schema.get("required", [])) or extra is False and any(k not in own for k in value):
            return False
        return all(conforms(x, own.get(k, extra if isinstance(extra, dict) else {})) for k, x in value.items())
    return True


def _ordered(calls: dict[str, set[str]]) -> dict[str, int]:
    """Level of each call (with what it depends on) that lies neither in nor behind a cycle."""
    behind: dict[str, list[str]] = {}
    waits = {}
    for call, after in calls.items():
        known = [x for x in after if x in calls]
        waits[call] = len(known)
        for x in known:
            behind.setdefault(x, []).append(call)
    level = {call: 0 for call, n in waits.items() if not n}
    ready = list(level)
    for call in ready:  # grows: a call comes after all that it depends on
        for x in behind.get(call, ()):
            level[x] = max(level.get(x, 0), level[call] + 1)
            waits[x] -= 1
            if not waits[x]:
                ready.append(x)
    return {call: level[call] for call in ready}


def levels(calls: DataFrame, together: int = TOGETHER) -> DataFrame:
    """conv_id, call_id and level of calls (conv_id, call_id, after: identifiers that it depends on)."""
    calls = calls.filter("conv_id is not null and call_id is not null")
    weight = F.greatest(F.coalesce(F.size("after"), F.lit(0)), F.lit(0)) + 1
    large = store(calls.groupBy("conv_id").agg(F.sum(weight).alias("n")).filter(F.col("n") > together).select("conv_id"), "long-conversations")

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, out = None, {}, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32()), strict=True)], names=["conv_id", "call_id", "level"])

        for batch in batches:
            for conv, call, after in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if conv != own:
                    out += [(own, *x) for x in _ordered(held).items()]
                    own, held = conv, {}
                held.setdefault(call, set()).update(x for x in after or () if x is not None)
            if len(out) >= 1 << 14:
                yield batch_of(out)
                out = []
        if out := out + [(own, *x) for x in _ordered(held).items()]:
            yield batch_of(out)

    small = calls.join(large, "conv_id", "left_anti").select(F.col("conv_id").cast("long"), F.col("call_id").cast("string"), F.col("after").cast("array<string>"))
    found = small.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(ordered, "conv_id long, call_id string, level int")
    return found if large.isEmpty() else store(found, "call-levels").union(_levels_by_rounds(calls.join(large, "conv_id", "left_semi")))


def _levels_by_rounds(calls: DataFrame) -> DataFrame:
    """levels() by joins: each round settles the calls whose dependencies are all settled."""
    names = calls.select("conv_id", "call_id").distinct()
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("dep")).filter("dep is not null").distinct()
    edges = store(edges.join(names.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi"), "call-edges")
    fresh = store(names.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "call-levels")
    waits = store(edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n")).withColumn("level", F.lit(0)), "call-waits")
    parts = [fresh]
    while not fresh.isEmpty():
        # What is settled just now is taken off the waits of the calls behind it.
        met = edges.join(fresh.withColumnRenamed("call_id", "dep").withColumnRenamed("level", "before"), ["conv_id", "dep"])
        met = met.groupBy("conv_id", "call_id").agg(F.count("*").alias("met"), F.max("before").alias("before"))
        left = waits.join(met, ["conv_id", "call_id"], "left")
        level = F.greatest("level", F.coalesce(F.col("before") + 1, F.lit(0)))
        waits = store(left.select("conv_id", "call_id", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n"), level.alias("level")), "call-waits")
        fresh, waits = waits.filter("n = 0").select("conv_id", "call_id", "level"), waits.filter("n > 0")
        parts.append(fresh)
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls (conv_id, turn, call_id, name, arguments: JSON, after: array of call_id) and results (conv_id, turn, call_id, content).

    Returns conv_id, turn, kind (call or result), call_id, linked, level, valid (null for results) and message (canonical JSON; a
    call's holds its arguments and its result).
    """
    key = ["conv_id", "call_id"]
    order = calls.select("conv_id", "call_id", "after").transform(levels)
    answer = results.filter("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("answer"))
    asked = calls.select("conv_id", "turn", "call_id", "name", "arguments").join(answer, key, "left").join(order, key, "left")
    asked = asked.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.col("answer").isNotNull().alias("linked"), "level", "name", "arguments", F.col("answer.turn").alias("other"), F.col("answer.content").alias("content"))
    by_id = order.select("conv_id", "call_id", "level", F.lit(True).alias("known"))
    given = results.select("conv_id", "turn", "call_id", "content").join(by_id, key, "left")
    empty = F.lit(None).cast("string")
    given = given.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.coalesce("known", F.lit(False)).alias("linked"), (F.col("level") + F.when(F.col("known"), 1).otherwise(0)).alias("level"), empty.alias("name"), empty.alias("arguments"), F.lit(None).cast("long").alias("other"), "content")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["turn", "kind", "call_id", "linked", "name", "arguments", "other", "content"]).to_pylist()
            valid, messages = [], []
            for r in rows:
                if r["kind"] == "result":
                    valid.append(None)
                    messages.append(canonical({"content": r["content"], "role": "tool", "tool_call_id": r["call_id"]}))
                    continue
                arguments, text = _read(r["arguments"])
                schema = schemas.get(r["name"])
                valid.append(isinstance(arguments, dict) and schema is not None and conforms(arguments, schema))
                result = {"content": r["content"], "turn": r["other"]} if r["linked"] else None
                rest = canonical({"id": r["call_id"], "name": r["name"], "result": result, "role": "assistant"})
                messages.append(f'{{"arguments":{text},{rest[1:]}')
            kept = [batch.column(batch.schema.get_field_index(x)) for x in ("conv_id", "turn", "kind", "call_id", "linked", "level")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(valid, pa.bool_()), pa.array(messages, pa.string())], names=["conv_id", "turn", "kind", "call_id", "linked", "level", "valid", "message"])

    return asked.unionByName(given).mapInArrow(written, "conv_id long, turn long, kind string, call_id string, linked boolean, level int, valid boolean, message string")


_PLACED = "turn is not null and conv_id is not null"


def _call_id(turn: Column) -> Column:
    return F.concat(F.lit("call:"), F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chats (conv_id, turn, role, text): each user turn is a call, each assistant turn a result."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim("role")).alias("role"), F.col("text").cast("string").alias("text"))
    name = _call_id(F.col("turn"))
    users = rows.filter(f"role = 'user' and {_PLACED}").withColumn("call_id", name)
    first = store(users.groupBy("conv_id").agg(F.min("turn").alias("first"), F.count("*").alias("n")), "first-calls")
    users = join_hot(users, first, "conv_id")
    context = F.when(F.col("first") < F.col("turn"), _call_id(F.col("first")))
    arguments = F.to_json(F.struct(context.alias("context"), F.col("text").alias("prompt"), F.col("turn").alias("turn")))  # leaves nulls out
    calls = users.select("conv_id", "turn", "call_id", F.lit("respond").alias("name"), arguments.alias("arguments"), F.filter(F.array(context), lambda x: x.isNotNull()).alias("after"))
    results = rows.filter(f"role = 'assistant' and {_PLACED}")
    results = results.select("conv_id", "turn", _call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def linked_chats(messages: DataFrame) -> DataFrame:
    """Plain chats (conv_id, turn, role, text) as link() returns them; further messages have the kind message."""
    linked = link(*turns_as_calls(messages), RESPOND)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim("role")).alias("role"), F.col("text").cast("string").alias("content"))
    rest = rows.filter(f"not coalesce(role in ('user', 'assistant') and {_PLACED}, false)")
    written = F.to_json(F.struct("content", "role"), {"ignoreNullFields": "false"})
    nothing = {"call_id": "string", "level": "int", "valid": "boolean"}
    rest = rest.select("conv_id", "turn", F.lit("message").alias("kind"), F.lit(False).alias("linked"), written.alias("message"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    return linked.unionByName(rest)
