"""Operator 4: linking tool calls with their results.

1. *Link*: calls and results are hash-joined by (conversation, call id). Of
   several calls with one id the first counts, of several results the first;
   both numbers are kept. A result without call is an orphan.
2. *Validate*: a call's arguments are parsed and checked against its tool's
   schema (JSON Schema's type, enum, required, properties,
   additionalProperties, items, minimum, maximum, minLength, maxLength).
3. *Order*: an argument ``{"$ref": "<call id>"}`` makes a call depend on
   another call of its conversation. Calls are levelled in rounds: level 0
   depends on nothing, each round releases the calls whose last dependency was
   just released. Calls on or behind a cycle have no level and come last. Within
   a conversation calls are numbered by (level, position).
4. *Serialise*: one canonical JSON object per call (sorted keys, no spaces,
   numbers in shortest form).

Scale: a conversation, id or dependency may hold a third of all rows. Links
are combined map-side; releases are joined with salts; a round reads only the
edges and the calls released last, and is written to the shared folder;
numbering adds the offset of a block of CHUNK positions to the number within
the block, so no task sees a whole conversation. The number of rounds is the
longest chain of dependencies. Schemas are configuration, at most MAX_TOOLS.

Defined results: null arguments or text that is not a JSON object give the
error ``arguments: not an object`` (NaN and Infinity are not JSON); arguments nested deeper than
MAX_DEPTH are not read: they give an error and stay as they are; a number that
no double holds counts as null, a repeated key as its last value, with an error each; half a
surrogate pair stays an escape; an unknown tool gives ``unknown tool``; a
reference to an id that no call has is listed in ``missing_refs`` and does not
hold the call up; a reference to itself is a cycle; a null call id is the
empty id, a null conversation is a conversation; repeated rows count as
further calls or results; an empty table gives an empty table; further columns
do not matter.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterlens.llm import shared
from clusterlens.sources.tables import table

MAX_TOOLS = 10_000
CHUNK = 1024
MAX_DEPTH = 200
MAX_DIGITS = 4000

# Production schemas of the tools in derived events.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50},
        "context": {"type": "object"}}},
    "translate": {"type": "object", "required": ["text", "target"], "additionalProperties": False, "properties": {
        "text": {"type": "string"}, "target": {"enum": ["de", "en", "es", "fr"]}, "context": {"type": "object"}}},
    "measure": {"type": "object", "required": ["words"], "additionalProperties": False, "properties": {
        "words": {"type": "integer", "minimum": 2}, "ratio": {"type": "number", "maximum": 12},
        "context": {"type": "object"}}},
}

_KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        return _is(value, "number") and (isinstance(value, int) or math.isfinite(value) and value == int(value))
    return isinstance(value, _KINDS[kind])


def violations(value, schema: dict, at: str = "arguments") -> list[str]:
    """What in ``value`` the schema forbids, in a fixed order."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []  # another call's result: its value is not known yet
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, k) for k in kinds):
            return [f"{at}: not {' or '.join('an ' + k if k[0] in 'aio' else 'a ' + k for k in kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if _is(value, "number"):
        out += [f"{at}: below minimum"] if value < schema.get("minimum", value) else []
        out += [f"{at}: above maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    return out


def references(value) -> set[str]:
    """Call ids that a value refers to."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return {value["$ref"]}
        return set().union(*(references(x) for x in value.values())) if value else set()
    if isinstance(value, list):
        return set().union(*(references(x) for x in value)) if value else set()
    return set()


def _plain(value):
    if isinstance(value, float):
        if not math.isfinite(value):
            return None
        return int(value) if value == int(value) and abs(value) < 1e21 else value
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _escaped(text: str) -> str:
    """Half surrogate pairs as JSON escapes: no UTF-8 text can hold them."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return _escaped(json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def depth(text: str) -> int:
    """How deep the brackets of a JSON text nest (those in strings do not count)."""
    now = most = 0
    for c in re.findall(r"[\[{\]}]", re.sub(r'"(?:[^"\\]|\\.)*"', "", text, flags=re.S)):
        now += 1 if c in "[{" else -1
        most = max(most, now)
    return most


def read(text: str | None) -> tuple[object, list[str]]:
    """(value, errors) of a JSON text; the value is None when it cannot be read."""
    if text is None:
        return None, []
    if depth(text) > MAX_DEPTH:
        return None, [TOO_DEEP]
    errors: set[str] = set()

    def pairs(items):
        out = {}
        for k, v in items:
            if k in out:
                errors.add(_escaped(f"arguments: key {k} repeated"))
            out[k] = v
        return out

    def number(kind, digits: str):
        value = kind(digits) if len(digits) <= MAX_DIGITS else math.inf
        if isinstance(value, int) or math.isfinite(value):
            return value
        errors.add("arguments: a number out of range")

    def refused(name: str):
        raise ValueError(name)

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=refused,
                           parse_int=lambda t: number(int, t), parse_float=lambda t: number(float, t))
    except (ValueError, RecursionError):
        return None, []
    return value, sorted(errors)


TOO_DEEP = f"arguments: nested deeper than {MAX_DEPTH}"


def linked(events: DataFrame) -> DataFrame:
    """One row per (conv_id, call_id): the first call, the first result, and
    how many there are of each."""
    events = events.select(
        "conv_id", F.coalesce("call_id", F.lit("")).alias("call_id"), "pos", "kind", "name", "arguments", "content")

    def firsts(kind: str, prefix: str, *cols: str) -> DataFrame:
        own = F.struct("pos", *cols)
        return events.where(F.col("kind") == kind).groupBy("conv_id", "call_id").agg(
            F.min(own).alias(prefix), F.count(F.lit(1)).alias(f"n_{prefix}s"))

    calls, results = firsts("call", "call", "name", "arguments"), firsts("result", "result", "content")
    results = results.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), "result", "n_results")
    both = calls.join(results, calls["conv_id"].eqNullSafe(results["rc"]) & (calls["call_id"] == results["ri"]), "full")
    is_call = F.col("call").isNotNull()
    return both.select(
        F.when(is_call, F.col("conv_id")).otherwise(F.col("rc")).alias("conv_id"), F.coalesce("call_id", "ri").alias("call_id"),
        F.col("call.pos").alias("pos"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"),
        F.col("result.pos").alias("result_pos"), F.col("result.content").alias("content"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        is_call.alias("is_call"))


def validated(calls: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """``calls`` with canonical ``arguments``, ``errors`` and ``refs``."""
    if len(tools) > MAX_TOOLS:
        raise ValueError(f"at most {MAX_TOOLS} tools")
    schema = calls.select("*", F.array().cast("array<string>").alias("errors"),
                          F.array().cast("array<string>").alias("refs")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors, refs = [], [], []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist(), strict=True):
                value, found = read(text)
                if name not in tools:
                    errors.append(["unknown tool", *found])
                elif TOO_DEEP in found:
                    errors.append(found)
                else:
                    own = violations(value, {"type": "object", **tools[name]})
                    errors.append([*found, *map(_escaped, own)])
                texts.append(text if TOO_DEEP in found else canonical(value) if value is not None else None)
                refs.append(sorted(map(_escaped, references(value))))
            kept = [pa.array(texts, pa.string()) if n == "arguments" else batch.column(n) for n in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(errors, pa.list_(pa.string())),
                                              pa.array(refs, pa.list_(pa.string()))], names=names)

    return calls.mapInArrow(run, schema)


def levels(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, missing) of ``calls`` (key, conv_id, refs): levels (key, level)
    of the calls outside cycles, missing (key, ref) for unknown references."""
    edges = calls.select("key", "conv_id", F.explode("refs").alias("ref"))
    edges = edges.withColumn("need", F.xxhash64("conv_id", "ref"))
    edges = shared.lookup(edges, "need", calls.select(F.col("key").alias("need"), F.lit(True).alias("known")), "key")
    edges = shared.written(edges.select("key", "ref", "need", "known"), "call-edges")
    missing = edges.where("known IS NULL").select("key", "ref")
    edges = edges.where("known").select("key", "need")
    waits = shared.written(edges.groupBy("key").agg(F.count(F.lit(1)).alias("left")), "call-waits")
    done = [calls.select("key").join(waits.select("key"), "key", "left_anti").withColumn("level", F.lit(0))]
    fresh, level = shared.written(done[0], "call-level"), 0
    done[0] = fresh
    while True:
        level += 1
        freed = shared.lookup(edges, "need", fresh.select(F.col("key").alias("need")), "key", "inner")
        freed = freed.groupBy("key").agg(F.count(F.lit(1)).alias("freed"))
        waits = waits.join(freed, "key", "left").select("key", (F.col("left") - F.coalesce("freed", F.lit(0))).alias("left"))
        waits = shared.written(waits, "call-waits")
        fresh = shared.written(waits.where("left = 0").select("key", F.lit(level).alias("level")), "call-level")
        if fresh.isEmpty():
            return reduce(DataFrame.union, done), missing
        done.append(fresh)
        waits = waits.where("left > 0")


def numbered(calls: DataFrame) -> DataFrame:
    """``calls`` with ``order``: 0, 1, ... within the conversation by (level,
    pos, call_id), cyclic calls last."""
    rank = F.coalesce("level", F.lit(2**31 - 1))
    calls = calls.withColumn("_rank", rank).withColumn("_chunk", F.expr(f"pos div {CHUNK}"))
    calls = calls.withColumn("_part", F.xxhash64("conv_id", "_rank", "_chunk"))
    size = calls.groupBy("_part").agg(F.first("conv_id").alias("c"), F.first("_rank").alias("r"),
                                      F.first("_chunk").alias("k"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c").orderBy("r", "k").rowsBetween(Window.unboundedPreceding, -1)
    start = size.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part").orderBy("pos", "call_id")
    out = calls.withColumn("_n", F.row_number().over(within) - 1).join(start, "_part")
    return out.withColumn("order", F.col("_start") + F.col("_n")).drop("_rank", "_chunk", "_part", "_n", "_start")


def link_tool_calls(events: DataFrame, tools: dict[str, dict] = TOOLS) -> DataFrame:
    """Calls and orphan results of ``events`` (conv_id, pos, kind, call_id, name,
    arguments, content): conv_id, call_id, status (linked, no_result, orphan),
    order, level, name, arguments, errors, refs, missing_refs, n_calls,
    n_results, record (canonical JSON; null for orphans)."""
    rows = shared.written(linked(events), "links")
    calls = validated(rows.where("is_call"), tools).withColumn("key", F.xxhash64("conv_id", "call_id"))
    calls = shared.written(calls, "calls")
    level, missing = levels(calls.select("key", "conv_id", "refs"))
    missing = missing.groupBy("key").agg(F.array_sort(F.collect_set("ref")).alias("missing_refs"))
    calls = calls.join(level, "key", "left").join(missing, "key", "left")
    calls = numbered(calls.withColumn("missing_refs", F.coalesce("missing_refs", F.array().cast("array<string>"))))
    calls = calls.withColumn("status", F.when(F.col("n_results") > 0, "linked").otherwise("no_result"))

    cols = ["conv_id", "call_id", "order", "name", "arguments", "content", "status", "errors", "refs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in pa.RecordBatch.from_arrays([batch.column(c) for c in cols], names=cols).to_pylist():
                value, found = read(r["arguments"])
                out.append(canonical({
                    "conv_id": r["conv_id"], "call_id": r["call_id"], "order": r["order"], "name": r["name"],
                    "arguments": r["arguments"] if found else value, "depends_on": r["refs"], "errors": r["errors"],
                    "result": r["content"], "status": r["status"]}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())],
                                             names=[*batch.schema.names, "record"])

    final = ["conv_id", "call_id", "status", "order", "level", "name", "arguments", "errors", "refs", "missing_refs",
             "n_calls", "n_results", "content"]
    calls = calls.select(*final)
    calls = calls.mapInArrow(run, calls.select("*", F.lit("").alias("record")).schema)
    orphans = rows.where("NOT is_call").select(
        "conv_id", "call_id", F.lit("orphan").alias("status"), F.lit(None).cast("bigint").alias("order"),
        F.lit(None).cast("int").alias("level"), "name", "arguments", F.lit(None).cast("array<string>").alias("errors"),
        F.lit(None).cast("array<string>").alias("refs"), F.lit(None).cast("array<string>").alias("missing_refs"),
        "n_calls", "n_results", "content", F.lit(None).cast("string").alias("record"))
    return calls.unionByName(orphans)


def conversation_events(conv: DataFrame) -> DataFrame:
    """Tool events derived from ``conversations``: every line of an assistant
    turn is a call, the same line of the following turn its result. Later
    lines of a turn refer to an earlier one, a turn's first line to the first
    line of a turn half as far on."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    rows = conv.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.posexplode(lines).alias("i", "line"))
    words = F.size(F.split(F.trim("line"), r"\s+"))
    ref = F.when(F.col("i") > 0, F.concat(F.lit("c"), F.col("turn"), F.lit("_"), F.expr("(i - 1) div 2"))) \
        .when(F.col("turn") > 2, F.concat(F.lit("c"), F.expr("2 * (turn div 4) + 1"), F.lit("_0")))
    context = F.when(ref.isNotNull(), F.struct(ref.alias("$ref")))
    pick = F.pmod(F.xxhash64("line"), F.lit(4))
    target = F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", "xx")]), (words % 5 + 1).cast("int"))
    arguments = F.when(pick < 2, F.to_json(F.struct(F.col("line").alias("query"), (words % 60).alias("limit"), context.alias("context")))) \
        .when(pick == 2, F.to_json(F.struct(target.alias("target"), F.col("line").alias("text"), context.alias("context")))) \
        .otherwise(F.to_json(F.struct(words.alias("words"), (F.char_length("line") / words).alias("ratio"), context.alias("context"))))
    name = F.when(pick < 2, "search").when(pick == 2, "translate").otherwise("measure")
    call = F.col("role") == "assistant"
    at = F.when(call, F.col("turn")).otherwise(F.col("turn") - 1)
    out = rows.where(call | (F.col("turn") > 0)).select(
        "conv_id", (F.shiftleft(F.col("turn"), 20) + F.col("i")).alias("pos"), F.when(call, "call").otherwise("result").alias("kind"),
        F.concat(F.lit("c"), at, F.lit("_"), F.col("i")).alias("call_id"), F.when(call, name).alias("name"),
        F.when(call, arguments).alias("arguments"), F.when(~call, F.col("line")).alias("content"))
    return out


def op4_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls derived from all ``conversations``, linked and serialised."""
    return link_tool_calls(conversation_events(table(spark, sf_dir, "conversations")))
