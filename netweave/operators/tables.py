"""Unions and column-wise cleaning of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.functions.numeric import coerce_double
from netweave.operators.ordering import with_row_ids
from netweave.plans.mapping import MappingSpec, Target, column, conform


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Rows of all frames, matched by column name; absent columns become null."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def union_tagged(frames: Mapping[str, DataFrame], tag_col: str = "source", allow_missing: bool = True) -> DataFrame:
    """Union with the mapping's key as a last column."""
    out = union_all([df.withColumn(tag_col, F.lit(tag)) for tag, df in frames.items()], allow_missing)
    return out.select(*[column(c) for c in out.columns if c != tag_col], tag_col)


def source_tag(prefix: str = "", suffix: str = ".csv"):
    """The input file's base name without a prefix and suffix."""
    base = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return F.regexp_replace(F.regexp_replace(base, f"^{prefix}", ""), suffix.replace(".", r"\.") + "$", "")


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in expected if c not in have]


def convert(df: DataFrame, spec: MappingSpec, order_by: Sequence[str] | None = None, start: int = 0,
            unmapped: str = "default") -> DataFrame:
    """Conform and, when the spec numbers its rows and an order is given, add the ids."""
    if spec.sequence and order_by:
        # The order columns ride along under private names until the ids exist.
        kept = {f"_o{i}": c for i, c in enumerate(order_by)}
        out = conform(df, with_passthrough(spec, kept), unmapped)
        return with_row_ids(out, list(kept), start, spec.sequence).drop(*kept)
    return conform(df, spec, unmapped)


def with_passthrough(spec: MappingSpec, kept: dict[str, str]) -> MappingSpec:
    """The spec with extra columns ``{new name: source}`` passed through untouched."""
    extra = tuple(Target(name, (source,), None, kind="raw") for name, source in kept.items())
    return replace(spec, targets=spec.targets + extra, order=())


def coerce_if_all(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Turn a text column into numbers only when every non-null value is one."""
    text = [c for c, t in df.dtypes if t == "string" and (cols is None or c in cols)]
    if not text:
        return df
    bad = df.agg(*[
        F.count_if(column(c).isNotNull() & coerce_double(column(c)).isNull()).alias(f"b{i}") for i, c in enumerate(text)
    ]).first()
    clean = {c for i, c in enumerate(text) if bad[f"b{i}"] == 0}
    return df.select(*[(coerce_double(column(c)) if c in clean else column(c)).alias(c) for c in df.columns])


def fill_constant(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    """Null (and NaN in numeric columns) to a constant."""
    return df.fillna(value, subset=list(cols) if cols else None)


def fill_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null and NaN to the column mean, found in one pass."""
    clean = {c: F.when(~F.isnan(column(c)), column(c)) for c in cols}
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(clean.values())]).first()
    filled = {c: F.coalesce(clean[c], F.lit(means[f"m{i}"])).alias(c) for i, c in enumerate(cols)}
    return df.select(*[filled.get(c, column(c)) for c in df.columns])
