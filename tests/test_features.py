import math
import statistics
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.checks.base import NUMERIC, TEXT, labelled
from netweave.functions.numeric import normal_quantile
from netweave.operators import features as feat
from netweave.operators.quantiles import quantiles
from netweave.plans import presets

SKEWED = [1.0, 2.0, 3.0, 4.0, 100.0]


@pytest.fixture(scope="module")
def column_df(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(SKEWED)], "k int, x double")


def values(df, c="x"):
    return [r[c] for r in df.orderBy("k").collect()]


def test_clip_skew_and_scale_by_hand(column_df):
    bounds = feat.fit_bounds(column_df, ["x"])
    assert bounds.limits["x"] == (-1.0, 7.0)
    clipped = bounds.apply(column_df)
    assert values(clipped) == [1, 2, 3, 4, 7]
    skew = clipped.agg(feat.adjusted_skewness(F.col("x")).alias("s")).first()["s"]
    assert skew == pytest.approx(1.0326585394, abs=1e-9)
    assert "x" in feat.fit_skew_log(clipped, ["x"]).shift
    assert column_df.agg(feat.adjusted_skewness(F.col("x")).alias("s")).first()["s"] == pytest.approx(2.2323959116, abs=1e-9)
    assert values(feat.fit_scaler(clipped, ["x"], "robust").apply(clipped)) == [-1, -0.5, 0, 0.5, 2]
    got = values(feat.fit_scaler(clipped, ["x"], "standard").apply(clipped))
    assert got == pytest.approx([-1.165543, -0.679900, -0.194257, 0.291386, 1.748315], abs=1e-6)


def test_constants_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(0, 5.0, None), (1, 5.0, None), (2, None, None)], "k int, x double, e double")
    for kind in ("robust", "standard", "minmax", "global_minmax"):
        scaler = feat.fit_scaler(df, ["x", "e"], kind)
        assert values(scaler.apply(df)) == [0.0, 0.0, None]
    assert feat.fit_bounds(df, ["x", "e"]).apply(df).count() == 3
    assert feat.fit_skew_log(df, ["x", "e"]).shift == {}


@pytest.mark.parametrize("small", [0, 10**9])
def test_quantiles_match_interpolation(spark, small):
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.exponential(50, 3000), np.full(1500, 7.25)])  # a third of the rows share a value
    b = rng.normal(size=4500)
    rows = [(float(x), float(y) if i % 10 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles(df, ["a", "b"], probs, small=small)
    assert got["a"] == pytest.approx(np.quantile(a, probs).tolist(), abs=1e-9)
    kept = [y for _, y in rows if y is not None]
    assert got["b"] == pytest.approx(np.quantile(kept, probs).tolist(), abs=1e-9)


def test_both_ways_to_quantiles_agree(spark):
    """Undefined, infinite, constant, nearly constant and widely spread values; few and many ranks."""
    rng = np.random.default_rng(1)
    n = 6000
    gaps, ends, spike, wide = rng.normal(size=n) * 100, rng.normal(size=n), np.full(n, 3.0), np.exp(rng.normal(size=n) * 100)
    gaps[::8], ends[:900], ends[900:1500], spike[5] = np.nan, np.inf, -np.inf, 2.0 ** 53
    wide[::3] *= -1
    rows = [(*map(float, r), 7.0, float(i % 3), None, -0.0 if i % 2 else 0.0) for i, r in enumerate(zip(gaps, ends, spike, wide))]
    names = ["gaps", "ends", "spike", "wide", "same", "ties", "none", "zero"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    for probs in ([0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0], [i / 999 for i in range(1000)]):
        one, other = quantiles(df, names, probs), quantiles(df, names, probs, small=0)
        for c in names:
            assert str(one[c]) == str(other[c]) or one[c] == pytest.approx(other[c], rel=1e-12, nan_ok=True), c
    assert one["gaps"] == pytest.approx(np.quantile(gaps[~np.isnan(gaps)], probs).tolist(), abs=1e-9)
    assert one["none"] == [None] * 1000 and one["ends"][0] == -np.inf and one["ends"][-1] == np.inf


def test_quantile_scaler_is_exact_at_every_size(spark):
    df = spark.range(3000).selectExpr("id * id % 997 / 7.0 AS x")
    assert feat.fit_quantile_scaler(df, ["x"], 100, small=0).knots == feat.fit_quantile_scaler(df, ["x"], 100).knots


def test_one_hot_cells(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", None), (3, "b", "y")], "k int, p string, q string")
    encoder = feat.fit_encoder(df, ["p", "q"])
    cells = {(r["k"], r["feature"]): r["code"] for r in feat.one_hot_cells(df, encoder, "k").collect()}
    wide = {(r["k"], f): r[f"{f}_code"] for r in encoder.apply(df, suffix="_code").collect() for f in ("p", "q")}
    assert len(cells) == 6 and cells == wide


def test_released_tables_are_gone(spark):
    import netweave.session as session

    before = set(session._written)
    kept = session.materialize(spark.range(3), "kept")
    lost = session.materialize(spark.range(3), "lost")
    path = [p for p in session._written if "/lost-" in p]
    # Only what this test wrote; other tests may still read theirs.
    assert session.release(spark, keep=[p for p in session._written if p not in path]) == 1
    assert kept.count() == 3 and before <= session._written
    with pytest.raises(Exception):
        spark.read.parquet(path[0])
    assert lost.columns == ["id"]


def test_normal_quantile():
    ps = [1e-9, 1e-7, 0.001, 0.02425, 0.075, 0.2, 0.4999, 0.5, 0.6, 0.95, 0.99999, 1 - 1e-7]
    want = [statistics.NormalDist().inv_cdf(p) for p in ps]
    assert normal_quantile(np.array(ps)).tolist() == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_quantile_scaler_ties_and_ends(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0, 4.0])], "k int, x double")
    scaler = feat.fit_quantile_scaler(df, ["x"], normal=False)
    assert values(scaler.apply(df)) == [0.0, 0.0, 0.0, 0.75, 1.0]
    other = spark.createDataFrame([(0, 3.0), (1, -5.0), (2, 9.0), (3, None)], "k int, x double")
    assert values(scaler.apply(other)) == [0.875, 0.0, 1.0, None]
    normal = values(feat.fit_quantile_scaler(df, ["x"]).apply(df))
    assert normal[-1] == pytest.approx(5.19933, abs=1e-4) and normal[0] == pytest.approx(-5.19933, abs=1e-4)


def test_encoder(spark, monkeypatch):
    df = spark.createDataFrame([(0, "tcp"), (1, "udp"), (2, None)], "k int, p string")
    encoder = feat.fit_encoder(df, ["p"])
    assert values(encoder.apply(df), "p") == [1, 2, 0]
    other = spark.createDataFrame([(0, "icmp"), (1, "udp")], "k int, p string")
    assert values(encoder.apply(other), "p") == [0, 2]
    assert [tuple(r) for r in encoder.unseen_values(other).collect()] == [("p", "icmp", 1)]
    assert encoder.apply(other.drop("p")).first()["p"] == 0
    with pytest.raises(Exception, match="unseen value icmp"):
        encoder.apply(other, unseen="error").collect()
    # The distributed path for vocabularies too large to hold.
    monkeypatch.setattr(feat, "SMALL_VOCABULARY", 1)
    big = feat.fit_encoder(df, ["p"])
    assert values(big.apply(df), "p") == [1, 2, 0]


def test_one_hot_refuses_wide_columns(spark):
    df = spark.range(20).selectExpr("cast(id as string) AS v", "id")
    assert len(feat.one_hot(df).columns) == 21
    with pytest.raises(ValueError):
        feat.one_hot(df, limit=10)


def test_correlation_of_constant_is_dropped(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 2.0, 1), (3.0, 2.0, 1)], "a double, c double, y int")
    assert feat.select_by_corr(df, ["a", "c"], "y") == ["a"]
    assert feat.select_by_corr(df, ["a", "c"], "y", top=5) == ["a"]


def test_packed_products(spark):
    df = spark.createDataFrame([(2.0, 3.0, 5.0)], "a double, b double, c double")
    assert df.select(feat.packed_products(["a", "b", "c"]).alias("p")).first()["p"] == [6.0, 10.0, 15.0]
    assert df.select(feat.packed_products(["a", "b", "c"], 2).alias("p")).first()["p"] == [6.0, 10.0]
    assert feat.interactions(df, ["a", "b", "c"], 1).columns[-1] == "a_b_inter"


def test_hundreds_of_products_have_columns_too(spark):
    many = [f"c{i}" for i in range(20)]
    df = spark.range(3).select("id", *[(F.col("id") + i).cast("double").alias(c) for i, c in enumerate(many)])
    out = feat.interactions(df, many)
    assert len(out.columns) == 21 + 190
    for r in out.collect():
        assert all(r[f"{a}_{b}_inter"] == r[a] * r[b] for a, b in feat.pair_names(many))


@pytest.fixture(scope="module")
def chain(spark, sf):
    df = labelled(spark, sf)
    return df, feat.FlowPreprocessor(numeric=NUMERIC, text=TEXT, label="label").fit(df)


def rows(df):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()])


def test_state_round_trip(spark, chain, tmp_path):
    df, model = chain
    model.save(spark, str(tmp_path / "m"))
    back = feat.FlowPreprocessorModel.load(spark, str(tmp_path / "m"))
    assert back.feature_names() == model.feature_names()
    assert rows(back.transform(df, ["row_id"])) == rows(model.transform(df, ["row_id"]))


def test_quantile_chain_round_trip(spark, sf, tmp_path):
    df = labelled(spark, sf)
    model = presets.subset_quantile().fit(df)
    model.save(spark, str(tmp_path / "q"))
    back = feat.FlowPreprocessorModel.load(spark, str(tmp_path / "q"))
    assert rows(back.transform(df, ["row_id"])) == rows(model.transform(df, ["row_id"]))


def test_standardised_output(chain):
    df, model = chain
    out = model.transform(df)
    for c in model.feature_names():
        mean, sd = out.agg(F.avg(c), F.stddev_pop(c)).first()
        assert abs(mean) < 1e-9 and sd == pytest.approx(1.0, abs=1e-9)


def test_many_products_take_the_packed_path(chain, monkeypatch):
    df, model = chain
    plain = rows(model.transform(df, ["row_id"]))
    vectors = {r["row_id"]: r["features"].toArray() for r in model.vector(df, ["row_id"]).collect()}
    monkeypatch.setattr(feat, "_WIDE", 1)
    packed = feat.FlowPreprocessor(numeric=NUMERIC, text=TEXT, label="label").fit(df)
    assert packed.is_wide()
    wide = rows(packed.transform(df, ["row_id"]))
    assert len(plain) == len(wide)
    for a, b in zip(plain, wide):
        assert a == pytest.approx(b, abs=1e-7)
    for r in packed.vector(df, ["row_id"]).collect():
        assert r["features"].toArray() == pytest.approx(vectors[r["row_id"]], abs=1e-7)


def test_a_fit_reads_its_source_once(spark, sf):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    df = labelled(spark, sf)
    n = df.count()
    watched = df.withColumn("src_bytes", counted("src_bytes"))
    feat.FlowPreprocessor(numeric=NUMERIC, text=TEXT, label="label", percentile_clip=True, scale="quantile").fit(watched)
    assert seen.value == n


def test_limited_chain(spark, sf, tmp_path, monkeypatch):
    df = labelled(spark, sf).withColumn("src_bytes", F.when(F.col("flag") != "S0", F.col("src_bytes")))
    names = [*NUMERIC, "Flow Bytes/s"]
    df = df.withColumn("Flow Bytes/s", F.exp(F.col("duration") / 100))
    model = presets.standard_limited(names, TEXT).fit(df)
    plain = rows(model.transform(df, ["row_id"]))
    inner = [v for r in plain for v in r[1:]]
    assert min(inner) == 0.0 and max(inner) == 1.0
    model.save(spark, str(tmp_path / "m"))
    back = feat.FlowPreprocessorModel.load(spark, str(tmp_path / "m"))
    assert back.means == model.means and rows(back.transform(df, ["row_id"])) == plain
    monkeypatch.setattr(feat, "_WIDE", 1)
    chain = replace(presets.standard_limited(names, TEXT), use_pairs=True)
    packed = chain.fit(df)
    assert packed.is_wide()
    wide = rows(packed.transform(df, ["row_id"]))
    monkeypatch.setattr(feat, "_WIDE", 100)
    for a, b in zip(rows(chain.fit(df).transform(df, ["row_id"])), wide):
        assert a == pytest.approx(b, abs=1e-9)


def test_fitted_bounds_by_default_refit_on_request(spark, chain):
    df, model = chain
    moved = df.withColumn("src_bytes", F.col("src_bytes") * 10)
    other = model.refit_bounds(moved)
    assert other.bounds[0].limits["src_bytes"] != model.bounds[0].limits["src_bytes"]
    assert other.scalers is model.scalers


@pytest.mark.parametrize("preset", ["subset_robust", "subset_robust_short", "subset_minmax", "subset_quantile"])
def test_presets(spark, sf, preset):
    df = labelled(spark, sf)
    model = getattr(presets, preset)().fit(df)
    row = model.transform(df, ["row_id"]).first()
    assert len(row) == 7 and all(math.isfinite(v) for v in row)
