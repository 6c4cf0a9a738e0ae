import pytest
from pyspark.sql import functions as F

from netweave.operators import sampling as smp
from netweave.operators import ordering
from netweave.operators.ordering import prefix_sums, with_row_ids


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))


@pytest.mark.parametrize("boundary", [20_000, 3])
def test_exact_quotas(keyed, monkeypatch, boundary):
    """Also when the cut has to be narrowed bit by bit."""
    monkeypatch.setattr(smp, "_BOUNDARY", boundary)
    got = smp.sample_quota(keyed, "y", {"a": 100, "b": 10**6}, "k")
    assert smp.group_sizes(got, "y") == {"a": 100, "b": 3333}
    again = smp.sample_quota(keyed.repartition(7), "y", {"a": 100}, "k").select("k")
    assert {r[0] for r in again.collect()} == {r["k"] for r in got.where("y = 'a'").collect()}
    assert smp.sample_quota(keyed, "y", {"a": 0}, "k").count() == 0


def test_rows_of_one_key_stay_together(spark):
    """Also a key with more rows than are ranked at once."""
    df = spark.range(30_000).select(F.when(F.col("id") < 25_000, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.lit("a").alias("y"))
    got = smp.sample_quota(df, "y", {"a": 26_000}, "k")
    sizes = {r["k"]: r["count"] for r in got.groupBy("k").count().collect()}
    assert sizes.pop(-1) == 25_000 and set(sizes.values()) == {1} and len(sizes) >= 1000
    few = smp.sample_quota(df, "y", {"a": 10}, "k").count()
    assert few in (10, *range(25_000, 25_011))


def test_stratified_shares(keyed):
    parts = smp.split_stratified(keyed, "y", 0.2, "k").groupBy("y", "split").count().collect()
    assert {(r["y"], r["split"]): r["count"] for r in parts} == {
        ("a", "test"): 333, ("a", "train"): 1334, ("b", "test"): 667, ("b", "train"): 2666}


def test_random_parts_and_folds(keyed):
    parts = {r["split"]: r["count"] for r in smp.split_random(keyed, [0.7, 0.3], "k").groupBy("split").count().collect()}
    assert sum(parts.values()) == 5000 and abs(parts["train"] - 3500) < 150
    twins = keyed.unionByName(keyed)
    folds = smp.with_fold(twins, 3, "k")
    assert folds.groupBy("k").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_one_row_group(spark):
    df = spark.createDataFrame([(1, "x")], "k int, y string")
    assert smp.split_stratified(df, "y", 0.2, "k").first()["split"] == "train"


@pytest.mark.parametrize("per_range", [10, 10**6])
def test_prefix_sums(spark, per_range):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).cast("double").alias("x"), F.lit(1).alias("n"),
                                  (F.col("id") % 2).alias("g"))
    out = prefix_sums(df, "x", {"below": "n"}, rows_per_range=per_range)
    assert out.where("below <> x + 1").count() == 0
    grouped = prefix_sums(df, "x", {"above": "n"}, ["g"], descending=True, rows_per_range=per_range).orderBy("g", F.desc("x"))
    for g in (0, 1):
        got = [r["above"] for r in grouped.where(f"g = {g}").collect()]
        assert got == list(range(1, len(got) + 1))


@pytest.mark.parametrize("order", [["x"], ["t"], ["hot", "x"], ["-x"]])
def test_row_ids(spark, order):
    df = spark.range(2000).select((F.col("id") * 7 % 2000).alias("x"), F.concat(F.lit("v"), F.col("id")).alias("t"),
                                  F.lit(1).alias("hot"))
    order = [F.desc("x")] if order == ["-x"] else order
    out = with_row_ids(df, order, start=1, rows_per_range=100)
    ids = [r["id"] for r in out.orderBy(*order).collect()]
    assert ids == list(range(1, 2001))


def test_ranges_are_cut_again_until_they_are_small(spark, monkeypatch):
    """Three levels of ranges: the sketch of four can only quarter what it sees."""
    df = spark.range(3000).select(F.pow(F.lit(1.01), F.col("id")).alias("x"), F.lit(1).alias("n"), (F.col("id") % 3).alias("g"))
    seen = []
    plain = ordering._numbered
    monkeypatch.setattr(ordering, "_numbered", lambda *a: seen.append(len(a[2])) or plain(*a))
    cuts, sizes = ordering._ranges(df, "x", 40, fan=4)
    assert len(seen) >= 3 and seen[0] == 3 and seen == sorted(seen)
    assert sum(sizes.values()) == 3000 and max(sizes.values()) <= 80 and len(cuts) == len(sizes) - 1
    ids = with_row_ids(df, ["x"], start=5, rows_per_range=40, fan=4)
    assert [r["id"] for r in ids.orderBy("x").collect()] == list(range(5, 3005))
    sums = prefix_sums(df, "x", {"below": "n"}, ["g"], rows_per_range=40, fan=4).orderBy("g", "x").collect()
    assert [r["below"] for r in sums] == list(range(1, 1001)) * 3


def test_ranges_of_one_value(spark):
    """A value that fills a range stands alone; infinite values and NaN keep their places."""
    x = F.when(F.col("id") % 2 == 0, 5.0).when(F.col("id") % 50 == 1, float("inf")).when(F.col("id") % 50 == 3, float("nan"))
    df = spark.range(2000).select(x.otherwise(F.col("id") / 100).alias("x"), F.col("id").alias("y"))
    cuts, sizes = ordering._ranges(df, "x", 50, fan=8)
    assert sum(sizes.values()) == 2000 and sorted(sizes.values())[-2] <= 150 and max(sizes.values()) >= 1000
    ids = with_row_ids(df, ["x", "y"], rows_per_range=50, fan=8)
    assert [r["id"] for r in ids.orderBy("x", "y").collect()] == list(range(2000))
    for one in (df.where("x = 5"), df.limit(0)):
        assert [r["id"] for r in with_row_ids(one, ["x", "y"], rows_per_range=50).orderBy("y").collect()] == list(range(one.count()))


def test_row_ids_put_nulls_first(spark):
    df = spark.createDataFrame([(None, 1), (5.0, 2), (float("nan"), 3), (1.0, 4)] * 50, "x double, y int")
    df = df.withColumn("z", F.monotonically_increasing_id())
    out = with_row_ids(df, ["x", "z"], rows_per_range=60)
    assert out.where("x IS NULL").agg(F.max("id")).first()[0] == 49
    assert out.where("isnan(x)").agg(F.min("id")).first()[0] == 150
