"""Work that needs a global order, without one giant partition.

The order is cut into value ranges taken from a sketch; a range that is still too full is cut
again by a sketch of its own, so any number of rows ends in ranges of bounded size.  Prefix
sums add up each range and let every range start from the total of those before it, and row
numbers do the same, or fall back to the partitions of a range-partitioned, written table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.session import materialize, small_table

ROWS_PER_RANGE = 200_000
#: Ranges that one sketch cuts its rows into, and ranges whose totals are added up together.
FAN = 1024


def _numbered(df: DataFrame, value: str, cuts: Sequence[float], out: str) -> DataFrame:
    """Number the rows by value range: nulls first (-1), NaN last, as sorting places them."""
    if not cuts:
        return df.withColumn(out, F.when(F.col(value).isNull(), -1).when(F.isnan(value), 1).otherwise(0))
    splits = [float("-inf"), *cuts, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=value, outputCol="_b", handleInvalid="keep").transform(df)
    number = F.when(F.col(value).isNull(), F.lit(-1)).otherwise(F.col("_b")).cast("int")
    return cut.withColumn(out, number).drop("_b")


def _ranges(df: DataFrame, value: str, rows_per_range: int, fan: int = FAN) -> tuple[list[float], dict[int, int]]:
    """Cuts between ranges of about ``rows_per_range`` rows, and the rows of each range.

    One read sketches the whole, one counts its ranges; only ranges with too many rows of
    different values are sketched and counted again.  Rows of one value cannot be told apart here.
    """
    probs = [i / fan for i in range(1, fan)]
    plain = F.when(~F.isnan(value), F.col(value))
    whole = df.agg(F.count("*").alias("n"), F.percentile_approx(plain, probs, 10 * fan).alias("q")).first()
    if whole["n"] <= rows_per_range:
        return [], {0: whole["n"]}
    cuts = sorted(_finite(whole["q"] or []))
    sizes: dict[int, int] = {}
    while True:
        ranged = _numbered(df, value, cuts, "_r")
        rows = ranged.groupBy("_r").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        sizes = {r["_r"]: r["n"] for r in rows}
        full = [r["_r"] for r in rows if r["_r"] >= 0 and r["n"] > 2 * rows_per_range and r["low"] < r["high"] and r["high"] == r["high"]]
        if not full:
            break
        # The cut at a range's least value sets it apart where it is what fills the range.
        again = ranged.where(F.col("_r").isin(full)).groupBy("_r").agg(
            F.percentile_approx(value, probs, 10 * fan).alias("q"), F.max(value).alias("high")).collect()
        more = _finite([c for r in again for c in (*r["q"], r["high"])])
        if more <= set(cuts):
            break
        cuts = sorted(set(cuts) | more)
    return _merged(cuts, sizes, rows_per_range)


def _finite(values: Iterable) -> set[float]:
    return {float(v) for v in values if math.isfinite(v)}


def _merged(cuts: list[float], sizes: dict[int, int], rows_per_range: int) -> tuple[list[float], dict[int, int]]:
    """Neighbouring ranges joined while they stay within ``rows_per_range``; nulls and NaN keep theirs."""
    last = len(cuts)
    kept, counts = [], {}
    held = sizes.get(0, 0)
    for i, c in enumerate(cuts):
        n = sizes.get(i + 1, 0)
        if held + n > rows_per_range and held:
            counts[len(kept)] = held
            kept.append(c)
            held = n
        else:
            held += n
    if held:
        counts[len(kept)] = held
    if -1 in sizes:
        counts[-1] = sizes[-1]
    if last + 1 in sizes:
        counts[len(kept) + 1] = sizes[last + 1]
    return kept, counts


def prefix_sums(df: DataFrame, order: str, sums: dict[str, str], by: Sequence[str] = (), descending: bool = False,
                rows_per_range: int = ROWS_PER_RANGE, fan: int = FAN) -> DataFrame:
    """Add inclusive running totals ``{output: input}`` along a numeric ``order``.

    ``df`` must hold one row per (``by``, ``order``), so aggregate first; this is
    also what keeps ties and hot values harmless.
    """
    by = list(by)
    key = F.desc(order) if descending else F.asc(order)
    cuts, sizes = _ranges(df, order, rows_per_range, fan)
    if len(sizes) <= 1:
        w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(o) for o, c in sums.items()])
    ranged = _numbered(df, order, cuts, "_range")
    if descending:
        ranged = ranged.withColumn("_range", -F.col("_range"))
    inner = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()]).withColumn(
        "_group", F.floor(F.col("_range") / fan))
    # Ranges are added up within groups of them, and then groups.
    before = Window.partitionBy(*by, "_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = totals.groupBy(*by, "_group").agg(*[F.sum(f"_t_{o}").alias(f"_t_{o}") for o in sums]).select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_group").alias("_g"),
        *[F.coalesce(F.sum(f"_t_{o}").over(outer), F.lit(0)).alias(f"_g_{o}") for o in sums])
    same = F.col("_group") == F.col("_g")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    offsets = totals.select(*by, "_range", "_group", *[
        F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums]).join(groups, same).select(
        *[F.col(c).alias(f"_of{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"),
        *[(F.col(f"_b_{o}") + F.col(f"_g_{o}")).alias(f"_s_{o}") for o in sums])
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_of{i}"))
    return ranged.join(offsets, same).select(
        *df.columns, *[(F.sum(c).over(inner) + F.col(f"_s_{o}")).alias(o) for o, c in sums.items()])


_ORDERED = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def with_row_ids(df: DataFrame, order_by: Sequence[str | Column], start: int = 0, name: str = "id",
                 rows_per_range: int = ROWS_PER_RANGE, fan: int = FAN) -> DataFrame:
    """Consecutive ids along ``order_by`` for any number of rows.

    Where the first order column is a number or a time whose values spread, its
    ranges are numbered side by side and offset by the rows before them.  Any other
    order goes through a range-partitioned table.  ``order_by`` must order the rows
    totally for the ids to be repeatable.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    first = order_by[0]
    keep = [F.col(f"`{c}`") for c in df.columns if c != name]
    if isinstance(first, str) and dict(df.dtypes)[first] in _ORDERED:
        ranged = _even_ranges(df, first, rows_per_range, fan)
        if ranged is not None:
            number = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) + F.col("_before") - 1
            return ranged.select((number + F.lit(start)).cast("long").alias(name), *keep)
    return _ids_by_table(df, keys, start, name, keep)


def _even_ranges(df: DataFrame, order: str, rows_per_range: int, fan: int) -> DataFrame | None:
    """Rows with their ``_range`` and the rows ``_before`` it; None if rows of one value fill a range."""
    kind = dict(df.dtypes)[order]
    value = F.col(order)
    if kind in ("date", "timestamp_ntz"):
        # Wall-clock days stay in order in every time zone.
        value = F.unix_date(value.cast("date"))
    elif kind == "timestamp":
        value = F.unix_micros(value)
    valued = df.withColumn("_v", value.cast("double"))
    cuts, counts = _ranges(valued, "_v", rows_per_range, fan)
    if len(counts) <= 1:
        return df.withColumns({"_range": F.lit(0), "_before": F.lit(0)})
    if max(counts.values()) > 8 * rows_per_range:
        return None
    total, starts = 0, []
    for r in sorted(counts):
        starts.append((r, total))
        total += counts[r]
    # One row for every range, each of many rows.
    before = small_table(df.sparkSession, starts, "_range int, _before bigint")
    return _numbered(valued, "_v", cuts, "_range").join(F.broadcast(before), "_range")


def _ids_by_table(df: DataFrame, keys: Sequence[Column], start: int, name: str, keep: Sequence[Column]) -> DataFrame:
    """Ids from a range-partitioned, sorted table, written once with each row's partition and
    position, so that the counts and the final ids refer to the same placement."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    position = F.monotonically_increasing_id()
    frozen = materialize(
        placed.withColumn("_slot", F.shiftright(position, 33)).withColumn("_pos", position.bitwiseAND((1 << 33) - 1)),
        "row-ids",
    )
    # One row per partition of the exchange.
    per_slot = frozen.groupBy("_slot").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slot.select("_slot", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_from"))
    return (
        frozen.join(F.broadcast(offsets), "_slot")
        .select((F.col("_from") + F.col("_pos") + F.lit(start)).cast("long").alias(name), *keep)
    )
