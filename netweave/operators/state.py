"""Column profiles kept as a table and merged: a new file costs one pass over that file.

The state of a part (a file, a day) is one row per column: exact counts and moments beside a
distinct sketch and a quantile sketch, and one row per value of a label with its exact count.
States are merged by aggregating their rows, which are as many as parts times columns, so a
profile of everything never reads the data again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.operators.profile import numeric_columns
from netweave.plans.mapping import column
from netweave.session import materialize

#: Sizes of the sketches: two to this power registers, and items of one level.
REGISTERS = 12
ITEMS = 400

_STATE = ("part string, feature string, value string, n bigint, nulls bigint, mean double, m2 double, low double, high double, "
          "registers binary, items binary")


def part_state(df: DataFrame, part: str, cols: Sequence[str] | None = None, label: str | None = None) -> DataFrame:
    """The state of every part of ``df``, told apart by the column ``part``, in one pass.

    Rows with a ``feature`` describe that column: ``n`` values that are not null, ``nulls``,
    mean, sum of squared deviations, range and both sketches, numbers only but for ``n``, ``nulls`` and the
    distinct sketch where the column is no number.  With ``label``, rows with a ``value`` count it (null: rows without one).
    Undefined numbers count as missing.
    """
    cols = list(cols or [c for c in df.columns if c not in (part, label)])
    numbers = set(numeric_columns(df.select(*[column(c) for c in cols])))
    aggs = []
    for i, c in enumerate(cols):
        v = column(c)
        if c in numbers:
            d = v.cast("double")
            d = F.when(~F.isnan(d), d)
            moments = [F.avg(d), F.var_pop(d) * F.count(d), F.min(d), F.max(d)]
            sketch = F.call_function("kll_sketch_agg_double", d, F.lit(ITEMS))
            seen = F.when(d.isNotNull(), v.cast("string"))
        else:
            moments, sketch, seen = [F.lit(None).cast("double")] * 4, F.lit(None).cast("binary"), v.cast("string")
        fields = [F.lit(c), F.lit(None).cast("string"), F.count(seen), F.count("*") - F.count(seen), *moments,
                  F.hll_sketch_agg(seen, F.lit(REGISTERS)), sketch]
        names = ("feature", "value", "n", "nulls", "mean", "m2", "low", "high", "registers", "items")
        aggs.append(F.struct(*[f.alias(n) for f, n in zip(fields, names)]).alias(f"c{i}"))
    key = F.coalesce(column(part).cast("string"), F.lit("")).alias("part")
    wide = df.groupBy(key).agg(*aggs)
    out = wide.select("part", F.explode(F.array(*[F.col(f"c{i}") for i in range(len(cols))])).alias("x")).select("part", "x.*")
    if label is not None:
        counts = df.groupBy(key, column(label).cast("string").alias("value")).agg(F.count("*").alias("n"))
        nothing = {"feature": "string", "nulls": "bigint", "mean": "double", "m2": "double", "low": "double", "high": "double",
                   "registers": "binary", "items": "binary"}
        counts = counts.withColumns({n: F.lit(None).cast(t) for n, t in nothing.items()})
        out = out.unionByName(counts.select(*out.columns))
    return out


def add_parts(spark: SparkSession, path: str, df: DataFrame, part: str, cols: Sequence[str] | None = None,
              label: str | None = None) -> DataFrame:
    """Add the parts of ``df`` that the state stored at ``path`` lacks, and return the whole state.

    Parts that are there are taken as they are; hand in only new files to read no others.
    """
    known = stored(spark, path)
    fresh = part_state(df, part, cols, label)
    if known is not None:
        fresh = fresh.join(F.broadcast(known.select("part").distinct()), "part", "left_anti")
    materialize(fresh, "profile-state").write.mode("append").parquet(path)
    return stored(spark, path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The state at ``path``; None if there is none."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(_STATE).parquet(path)


def merged_profile(state: DataFrame, fractions: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column over all parts: exact ``n``, ``nulls``, ``mean``, ``std`` and range, and from sketches
    ``distinct`` and ``quantiles``.

    Squared deviations are added up around the common mean, so parts far apart lose no digits.
    """
    rows = state.where("feature is not null")
    common = rows.groupBy("feature").agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("_mean"))
    each = rows.join(common, "feature")
    gap = F.col("mean") - F.col("_mean")
    total = each.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.max("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * gap * gap).alias("_m2"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.hll_sketch_estimate(F.hll_union_agg("registers")).alias("distinct"),
        F.call_function("kll_merge_agg_double", F.col("items")).alias("_items"))
    at = F.array(*[F.lit(float(f)) for f in fractions])
    return total.select(
        "feature", "n", "nulls", "mean", F.sqrt(F.try_divide(F.col("_m2"), F.col("n") - 1)).alias("std"), "low", "high", "distinct",
        F.when(F.col("low").isNotNull(), F.call_function("kll_sketch_get_quantile_double", F.col("_items"), at)).alias("quantiles"))


def merged_counts(state: DataFrame) -> DataFrame:
    """Exact (``value``, ``n``, ``share``) of the label over all parts."""
    counts = state.where("feature is null").groupBy("value").agg(F.sum("n").alias("n"))
    whole = state.where("feature is null").agg(F.sum("n")).first()[0]
    return counts.select("value", "n", (F.col("n") / F.lit(whole)).alias("share"))
