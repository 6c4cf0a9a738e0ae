import math
import statistics

import pytest
from pyspark.sql import functions as F

from netweave.operators import state


def frame(spark, n=3000):
    v = F.when(F.col("id") % 7 != 0, (F.col("id") % 1000).cast("double") + 1e6 * (F.col("id") % 3))
    return spark.range(n).select(
        (F.col("id") % 3).alias("file"), F.when(F.col("id") % 50 == 1, F.lit(float("nan"))).otherwise(v).alias("x.y"),
        F.when(F.col("id") % 4 != 0, F.concat(F.lit("t"), F.col("id") % 17)).alias("part"), (F.col("id") % 5).alias("k"),
        F.when(F.col("id") % 9 != 0, F.when(F.col("id") % 2 == 0, "a").otherwise("b")).alias("label"))


def by_feature(df):
    return {r["feature"]: r for r in df.collect()}


def test_merged_parts_equal_the_whole(spark):
    df = frame(spark)
    cols = ["x.y", "part", "k"]
    parts = state.part_state(df, "file", cols, "label")
    assert parts.where("feature is not null").count() == 9
    whole = state.part_state(df.withColumn("file", F.lit("all")), "file", cols, "label")
    a, b = by_feature(state.merged_profile(parts)), by_feature(state.merged_profile(whole))
    rows = df.collect()
    for c in cols:
        values = [r[c] for r in rows if r[c] is not None and r[c] == r[c]]
        for got in (a[c], b[c]):
            assert (got["n"], got["nulls"]) == (len(values), 3000 - len(values))
            exact = len(set(values))
            assert abs(got["distinct"] - exact) <= 0.05 * exact + 1
            if c == "part":
                assert got["mean"] is got["std"] is got["low"] is got["quantiles"] is None
            else:
                assert got["mean"] == pytest.approx(statistics.fmean(values), rel=1e-12)
                assert got["std"] == pytest.approx(statistics.stdev(values), rel=1e-9)
                assert (got["low"], got["high"]) == (min(values), max(values))
                below = [sum(v <= q for v in values) / len(values) for q in got["quantiles"]]
                assert all(abs(x - f) < 0.21 if c == "k" else abs(x - f) < 0.03 for x, f in zip(below, (0.25, 0.5, 0.75)))
        # An unmerged sketch has seen its values in order and says a little more than a merged one.
        assert abs(a[c]["distinct"] - b[c]["distinct"]) <= 0.03 * b[c]["distinct"]
    counts = {r["value"]: (r["n"], r["share"]) for r in state.merged_counts(parts).collect()}
    for v in ("a", "b", None):
        n = sum(r["label"] == v for r in rows)
        assert counts[v] == (n, pytest.approx(n / 3000))


def test_a_new_part_reads_only_itself(spark, tmp_path):
    df, path = frame(spark).withColumnRenamed("x.y", "x"), str(tmp_path / "state")
    assert state.stored(spark, path) is None
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def part(i):
        return df.where(F.col("file") == i).mapInArrow(counted, df.schema)

    for i in (0, 1, 2):
        before = read.value
        kept = state.add_parts(spark, path, part(i), "file", ["x", "k"])
        assert read.value - before == 1000
    again = state.add_parts(spark, path, df.where("file = 1"), "file", ["x", "k"])
    assert again.count() == kept.count() == 6
    whole = by_feature(state.merged_profile(state.part_state(df.withColumn("file", F.lit(0)), "file", ["x", "k"])))
    got = by_feature(state.merged_profile(again))
    assert got["x"]["n"] == whole["x"]["n"] and got["x"]["std"] == pytest.approx(whole["x"]["std"], rel=1e-12)


def test_state_of_nothing(spark):
    df = frame(spark, 30).withColumn("k", F.lit(None).cast("int"))
    got = by_feature(state.merged_profile(state.part_state(df, "file", ["k"])))["k"]
    assert (got["n"], got["nulls"], got["mean"], got["std"], got["quantiles"]) == (0, 30, None, None, None)
    assert state.merged_profile(state.part_state(df.limit(0), "file", ["k"])).count() == 0
    one = by_feature(state.merged_profile(state.part_state(frame(spark, 2), "file", ["k"])))["k"]
    assert one["n"] == 2 and not math.isnan(one["std"])
