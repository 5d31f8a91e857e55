"""Tool-call linking: calls and results are hash-joined by identifier, put in topological
order, validated against argument schemas, and serialised as canonical JSON.

A call may name the call whose result it uses (``parent_id``), so the calls of a
conversation form a forest. Depths come from pointer jumping: each round doubles the
distance that a call's pointer spans, so rounds grow with the logarithm of the longest
chain, and a conversation of any length is spread over all tasks. Calls that never reach
a root are on or below a cycle and are reported so. Positions are numbered by range
partitions, not by one task a conversation."""
from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_stage, stage


def canonical(value) -> str:
    """JSON with sorted keys (by code point), no spaces, whole floats as integers. NaN and
    infinities are not JSON and raise ValueError."""
    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float) and math.isfinite(v) and v == int(v) and abs(v) < 1 << 53:
            return int(v)
        return v
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """Violations of a JSON-schema subset: type, enum, required, properties,
    additionalProperties (false), items, minimum, maximum, minLength, maxLength."""
    errors, kind = [], schema.get("type")
    if kind:
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        ok = (number if kind == "number" else number and (isinstance(value, int) or value.is_integer()) if kind == "integer"
              else isinstance(value, _KINDS[kind]))
        if not ok:
            return [f"{at}: not of type {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{at}: not in the enumeration")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                errors += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                errors.append(f"{at}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            errors += schema_errors(v, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            errors.append(f"{at}: wrong length")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
            errors.append(f"{at}: out of range")
    return errors


def _checked(schemas: dict[str, dict]):
    def one(name: str | None, arguments: str | None) -> tuple[str | None, list[str]]:
        try:
            value = json.loads("" if arguments is None else arguments)
            text = canonical(value)
            return text, ["unknown tool"] if name not in schemas else schema_errors(value, schemas[name])
        except (ValueError, OverflowError, RecursionError):
            return None, ["$: not JSON"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(n, a) for n, a in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist())]
            cols = [c for n, c in zip(batch.schema.names, batch.columns) if n != "arguments"]
            names = [n for n in batch.schema.names if n != "arguments"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.list_(pa.string()))], names=[*names, "arguments", "errors"])
    return run


def depths(calls: DataFrame) -> DataFrame:
    """``calls(conv_id, call_id, parent_id)`` with distinct ids -> ``conv_id, call_id, depth``;
    depth is null for calls on or below a cycle. A parent that is not there is no parent."""
    have = calls.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("there"))
    at = calls.select("conv_id", "call_id", "parent_id").join(have, ["conv_id", "parent_id"], "left").select(
        "conv_id", "call_id", F.when(F.col("there"), F.col("parent_id")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"))
    at = stage(at, "calls")
    n = at.count()
    for _ in range(max(1, n).bit_length() + 1):
        if at.where("up is not null").isEmpty():
            break
        over = at.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        last, at = at, stage(at.join(over, ["conv_id", "up"], "left").select(
            "conv_id", "call_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "calls")
        delete_stage(last)
    return at.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def _numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``position`` from 0 within the key, whatever the key's size."""
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (key, *order)]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in (key, *order)])
    put = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = put.groupBy(key, part.alias("_p")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(key).alias("_k"), "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = put.withColumn("_p2", part).join(counts, (F.col("_p2") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    return joined.withColumn("position", F.col("_base") + F.col("_at") - F.col("_first")).drop("_at", "_p", "_p2", "_k", "_first", "_base")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls(conv_id, call_id, parent_id, turn, name, arguments)`` and ``results(conv_id,
    call_id, turn, content)`` -> one row a call, numbered by ``position`` in topological
    order (depth, then turn, then id; calls on cycles last), with ``arguments`` as canonical
    JSON (null if not JSON), ``errors``, the ``content`` of its result, and ``status``:
    linked, no_result, early_result (the result stands before the call) or cycle.

    Of calls or results that repeat an id, the first by turn counts. Calls without a
    conversation or an id are left out, as are results that no call names. Other columns
    are not read."""
    first = ["turn", "parent_id", "name", "arguments"]
    calls = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct(*[F.col(c) for c in first])).alias("c")).select("conv_id", "call_id", *[f"c.{c}" for c in first])
    calls = stage(calls, "calls")
    results = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("r")).select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"))
    linked = calls.join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(depths(calls), ["conv_id", "call_id"])
    status = (F.when(F.col("depth").isNull(), "cycle").when(F.col("result_turn").isNull(), "no_result")
              .when(F.col("result_turn") < F.col("turn"), "early_result").otherwise("linked"))
    ordered = _numbered(linked.withColumn("status", status).withColumn("_late", F.col("depth").isNull()),
                        "conv_id", ["_late", "depth", "turn", "call_id"]).drop("_late", "result_turn")
    types = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    names = [c for c in ordered.columns if c != "arguments"]
    schema = ", ".join([*(f"{c} {types[c]}" for c in names), "arguments string", "errors array<string>"])
    return ordered.mapInArrow(_checked(schemas), schema)


#: Argument schemas of the tools that ``conversation_calls`` names.
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1, "maxLength": 400}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "translate": {"type": "object", "required": ["text"], "additionalProperties": False, "properties": {
        "text": {"type": "string"}, "target": {"type": "string", "enum": ["de", "en", "es", "fr"]}}},
}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn asks (a call), the assistant's
    next turn answers (its result); a call uses the answer to the user's turn two before."""
    c = conversations.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    number = F.col("turn").cast("string")
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    search = words % 2 == 0
    arguments = F.when(search, F.to_json(F.struct(F.col("text").alias("query"), words.alias("limit")))).otherwise(
        F.to_json(F.struct(F.col("text").alias("text"), F.lit("en").alias("target"))))
    calls = c.where("role = 'user'").select(
        "conv_id", F.concat(F.lit("call-"), number).alias("call_id"),
        F.concat(F.lit("call-"), (F.col("turn") - 2).cast("string")).alias("parent_id"), "turn",
        F.when(search, "search").otherwise("translate").alias("name"), arguments.alias("arguments"))
    results = c.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def linked_conversations(conversations: DataFrame) -> DataFrame:
    out = link_calls(*conversation_calls(conversations), SCHEMAS)
    return out.select("conv_id", "position", "depth", "call_id", "parent_id", "turn", "name", "status", "arguments",
                      F.array_join("errors", "; ").alias("errors"), F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("content_sha256"))
