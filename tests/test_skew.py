import pytest
from pyspark.sql import functions as F

from netweave.operators import features, skew


@pytest.fixture()
def fixed_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def skewed(spark, n=40_000):
    """Half the rows on one key, a tenth without a key, the rest on many."""
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 5000))
    return spark.range(n).select("id", key.alias("key"), F.lit("x").alias("_part0"), F.create_map(F.lit(1), "id").alias("m"))


def test_heavy_hitters(spark):
    df = skewed(spark)
    digest = lambda k: spark.range(1).select(F.xxhash64(F.lit(k))).first()[0]
    got = skew.heavy_hitters(df, skew.digest_of(["key"]))
    assert digest("hot") in got and len(got) <= 3
    assert skew.heavy_hitters(df.limit(0), skew.digest_of(["key"])) == []
    even = spark.range(20_000).select((F.col("id") % 10_000).alias("key"))
    assert skew.heavy_hitters(even, skew.digest_of(["key"])) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_is_the_join(spark, how):
    df = skewed(spark, 6000).drop("m")
    small = spark.createDataFrame([("hot", 1), ("k3", 2), ("k7", 3), ("k7", 4), (None, 5), ("none", 6)], "key string, v int")
    want = sorted(map(tuple, df.join(small, "key", how).collect()), key=repr)
    got = skew.split_join(df, small, ["key"], how)
    assert got.columns == df.join(small, "key", how).columns
    assert sorted(map(tuple, got.collect()), key=repr) == want
    with pytest.raises(ValueError):
        skew.split_join(df, small, ["key"], "right")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_no_task_has_twice_the_median(spark, fixed_partitions, how):
    df = skewed(spark)
    small = df.select("key").distinct().withColumn("v", F.length("key"))

    def loads(joined):
        rows = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("v")).collect()
        return sorted(r["n"] for r in rows)

    plain, split = loads(df.join(small, "key", how)), loads(skew.split_join(df, small, ["key"], how))
    assert sum(plain) == sum(split) and len(split) == 8
    assert plain[-1] > 4 * plain[len(plain) // 2]
    assert split[-1] <= 2 * split[len(split) // 2]


def test_encoder_splits_large_vocabularies(spark, monkeypatch):
    """The same codes whether the vocabulary is sent around or joined with split keys."""
    df = skewed(spark, 8000).drop("m", "_part0")
    want = sorted(map(tuple, features.fit_encoder(df, ["key"]).apply(df).collect()))
    monkeypatch.setattr(features, "SMALL_VOCABULARY", 10)
    encoder = features.fit_encoder(df, ["key"])
    seen = []
    monkeypatch.setattr(features, "split_join", lambda *a, **k: seen.append(a) or skew.split_join(*a, **k))
    assert sorted(map(tuple, encoder.apply(df).collect())) == want and len(seen) == 1
