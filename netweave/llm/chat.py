"""Tool calls of conversations, linked to their results, ordered, checked and serialised.

Calls and results meet in a hash join on conversation and identifier.  A call may refer to
others by ``{"$ref": "<id>"}`` anywhere in its arguments, and then comes after them.  Where
all references point backwards the turns already are such an order; other conversations are
levelled in rounds that settle calls without open references and shorten chains by half.
Arguments are checked against the schema of their tool, and every record becomes canonical
JSON: sorted keys, no spaces, nothing escaped that need not be.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave.session import materialize

#: Turns of one level that are numbered together.
_STRETCH = 256
#: Levels whose counts are added up together.
_RUN = 4096


def canonical(value) -> str:
    """JSON with sorted keys and without spaces; whole floats lose their point."""
    return json.dumps(_plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float) and value.is_integer() and abs(value) < 2 ** 53:
        return int(value)
    return value


def references(value) -> list[str]:
    """The identifiers of all ``{"$ref": id}`` in a value."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return [value["$ref"]]
        value = list(value.values())
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


_KINDS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer(),
}


def violations(value, schema: Mapping, at: str = "$") -> list[str]:
    """Where a value breaks a schema (type, enum, bounds, lengths, pattern, items, properties, required)."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []  # stands for a result that is not known yet
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_KINDS[k](value) for k in kinds):
            return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if _KINDS["number"](value):
        out += [f"{at}: below minimum"] if value < schema.get("minimum", -math.inf) else []
        out += [f"{at}: above maximum"] if value > schema.get("maximum", math.inf) else []
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        out += [f"{at}: too short"] if len(value) < schema.get(low, 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get(high, math.inf) else []
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: no match")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    return out


def check_call(name: str | None, arguments: str | None, schemas: Mapping[str, Mapping]) -> tuple[str | None, str, list[str]]:
    """Canonical arguments (null if they are no JSON), what is wrong with them, and the ids they refer to."""
    try:
        value = json.loads(arguments if arguments is not None else "{}", parse_constant=_refuse)
        text = canonical(value)
        text.encode()
    except (ValueError, RecursionError):
        return None, "$: not JSON", []
    if name not in schemas:
        return text, "$: unknown tool", references(value)
    return text, "; ".join(violations(value, schemas[name])), references(value)


def _refuse(word: str):
    raise ValueError(word)


_CALL = "conv {0}, turn {1}, call_id string, name string, arguments string, errors string, refs array<string>"


def _checked(calls: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    schemas = dict(schemas)
    kinds = dict(calls.dtypes)

    def run(batches):
        for batch in batches:
            made = [check_call(n, a, schemas) for n, a in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.list_(pa.string()))],
                names=["conv", "turn", "call_id", "name", "arguments", "errors", "refs"])

    return calls.mapInArrow(run, _CALL.format(kinds["conv"], kinds["turn"]))


def _levels(calls: DataFrame) -> DataFrame:
    """(``conv``, ``call_id``, ``level``): the longest chain of references below a call, null for calls
    on or behind a circle of references.

    A round settles the calls whose references are all settled, and lets a reference to a call
    with one open reference of its own point to that one's target, with the steps added up: a
    chain takes as many rounds as its length has binary digits.  More steps than there are
    calls can only lead around a circle.
    """
    name, end = ["conv", "call_id"], ["conv", "ref"]
    known = calls.select("conv", F.col("call_id").alias("ref"))
    edges = materialize(calls.select(*name, F.explode(F.array_distinct("refs")).alias("ref")).join(known, end).select(
        *name, "ref", F.lit(1).cast("long").alias("steps")), "open-references")
    nodes = materialize(calls.select(*name, F.lit(0).cast("long").alias("base"), F.lit(False).alias("lost")), "levels")
    bound = nodes.count()
    while not edges.isEmpty():
        out = edges.groupBy(*name).agg(F.count("*").alias("degree"), F.max("ref").alias("next"), F.max("steps").alias("far"))
        lost = F.col("lost") | F.coalesce(F.col("far") > bound, F.lit(False))
        state = materialize(nodes.join(out, name, "left").select(
            *name, "base", F.coalesce("degree", F.lit(0)).alias("degree"), "next", "far", lost.alias("lost")), "levels")
        target = state.where("degree <= 1 and not lost").select(
            "conv", F.col("call_id").alias("ref"), F.col("base").alias("_base"), F.col("degree").alias("_degree"),
            F.col("next").alias("_next"), F.col("far").alias("_far"))
        # A reference to a call on a circle, or to one with several open references, stays as it is.
        moved = materialize(edges.join(state.where("lost").select(*name), name, "left_anti").join(target, end, "left").select(
            *name, (F.col("_base") + F.col("steps")).alias("base"), F.col("_degree").isNotNull().alias("_moved"),
            F.when(F.col("_degree").isNull(), F.col("ref")).otherwise(F.col("_next")).alias("ref"),
            (F.col("steps") + F.coalesce("_far", F.lit(0))).alias("steps")), "moved-references")
        raised = moved.groupBy(*name).agg(F.max("base").alias("_raised"))
        nodes = materialize(state.join(raised, name, "left").select(
            *name, F.greatest("base", "_raised").alias("base"), "lost"), "levels")
        edges = materialize(moved.where(F.col("ref").isNotNull()).groupBy(*name, "ref").agg(F.max("steps").alias("steps")),
                            "open-references")
        if moved.where("_moved").isEmpty():
            break  # what is left waits for a circle, or is one of several references each
    waiting = edges.select(*name, F.lit(True).alias("_waits")).distinct()
    known = F.when(~F.col("lost") & F.col("_waits").isNull(), F.col("base"))
    return nodes.join(waiting, name, "left").select(*name, known.alias("level"))


def _numbered(calls: DataFrame) -> DataFrame:
    """Add ``position`` from 1 along level, turn and identifier, a stretch of turns at a time.

    Calls of one conversation, level and turn (or without one) are ranked together.
    """
    staged = calls.withColumn("_level", F.coalesce("level", F.lit(2 ** 62))).withColumn(
        "_part", F.floor(F.col("turn") / _STRETCH))
    # A long chain has a level for each call: counts are added up within runs of levels, and then over runs.
    sizes = staged.groupBy("conv", F.floor(F.col("_level") / _RUN).alias("_run"), "_level", "_part").agg(F.count("*").alias("_n"))
    runs = sizes.groupBy("conv", "_run").agg(F.sum("_n").alias("_all"))
    earlier = Window.partitionBy("conv").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("conv", "_run", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_start"))
    before = Window.partitionBy("conv", "_run").orderBy("_level", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(starts, ["conv", "_run"]).select(
        F.col("conv").alias("_c"), F.col("_level").alias("_l"), F.col("_part").alias("_p"),
        (F.col("_start") + F.col("_before")).alias("_from"))
    inner = Window.partitionBy("conv", "_level", "_part").orderBy("turn", "call_id")
    ranked = staged.withColumn("_rank", F.row_number().over(inner))
    same = (ranked["conv"].eqNullSafe(F.col("_c")) & (ranked["_level"] == F.col("_l"))
            & ranked["_part"].eqNullSafe(F.col("_p")))
    return ranked.join(offsets, same).withColumn("position", (F.col("_from") + F.col("_rank")).cast("long")).drop(
        "_level", "_part", "_rank", "_c", "_l", "_p", "_from")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row per call, and per result without a call: linked, placed, checked, serialised.

    ``calls`` has ``conv``, ``turn``, ``call_id``, ``name`` and ``arguments`` (JSON text; null: no
    arguments), ``results`` has ``conv``, ``turn``, ``call_id`` and ``content``; other columns do not
    matter.  Returns ``conv``, ``call_id``, ``turn``, ``position`` (null for a result without a call),
    ``level`` (null on or behind a circle), ``status`` (``linked``, ``no_result``, ``no_call``),
    ``valid``, ``errors``, ``n_calls`` and ``n_results`` (rows with this identifier) and ``json``.

    Of calls or results with one identifier the first by turn, then by content, counts.  Rows
    without a conversation or an identifier link with nothing and are left out.
    """
    named = F.col("conv").isNotNull() & F.col("call_id").isNotNull()
    asked = _checked(calls.where(named).select("conv", "turn", F.col("call_id").cast("string").alias("call_id"),
                                               F.col("name").cast("string").alias("name"),
                                               F.col("arguments").cast("string").alias("arguments")), schemas)
    body = ["turn", "name", "arguments", "errors", "refs"]
    asked = materialize(
        asked.groupBy("conv", "call_id").agg(F.min(F.struct(*body)).alias("_c"), F.count("*").alias("n_calls"))
        .select("conv", "call_id", *[F.col(f"_c.{c}").alias(c) for c in body], "n_calls"), "calls")
    given = (
        results.where(named).select("conv", "turn", F.col("call_id").cast("string").alias("call_id"),
                                    F.col("content").cast("string").alias("content"))
        .groupBy("conv", "call_id").agg(F.min(F.struct("turn", "content")).alias("_r"), F.count("*").alias("n_results")))
    ordered = _numbered(asked.join(_levels(asked), ["conv", "call_id"]))
    both = ordered.join(given.hint("shuffle_hash"), ["conv", "call_id"], "full")
    status = (F.when(F.col("n_calls").isNull(), "no_call").when(F.col("n_results").isNull(), "no_result")
              .otherwise("linked"))
    table = both.select(
        "conv", "call_id", F.coalesce("turn", F.col("_r.turn")).alias("turn"), "position", "level", status.alias("status"),
        F.coalesce(F.col("errors") == "", F.lit(False)).alias("valid"), F.coalesce("errors", F.lit("")).alias("errors"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "name", "arguments",
        F.col("_r.content").alias("content"))
    kinds = dict(table.dtypes)
    out = table.columns[:10]

    def serialise(batches):
        for batch in batches:
            lines = [canonical({
                "id": i, "name": n, "arguments": json.loads(a) if a is not None else None, "result": c, "status": s,
            }) for i, n, a, c, s in zip(*[batch.column(k).to_pylist() for k in (1, 10, 11, 12, 5)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:10], pa.array(lines, pa.string())], names=[*out, "json"])

    return table.mapInArrow(serialise, ", ".join(f"{c} {kinds[c]}" for c in out) + ", json string")
