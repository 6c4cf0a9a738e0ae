import numpy as np
import pytest

from netweave.operators import powerlaw as pl


@pytest.fixture(scope="module")
def zipf(spark):
    rng = np.random.default_rng(9)
    x = rng.zipf(2.5, 4000)
    return spark.createDataFrame([(float(v),) for v in x[x < 10**6]], "x double")


def test_exponent(zipf):
    fit = pl.fit_power_law(zipf, "x")
    assert 1 <= fit.xmin <= 10 and fit.alpha == pytest.approx(2.5, abs=0.25) and fit.distance < 0.05


def test_bounding_finds_the_same_cut_off(zipf, monkeypatch):
    direct = pl.fit_power_law(zipf, "x")
    monkeypatch.setattr(pl, "_PAIRS", 1000)
    monkeypatch.setattr(pl, "_GRID", 8)
    bounded = pl.fit_power_law(zipf, "x")
    assert (bounded.xmin, bounded.tail_rows) == (direct.xmin, direct.tail_rows)
    assert bounded.distance == pytest.approx(direct.distance, abs=1e-12)


def test_support_guard(spark):
    assert pl.fit_power_law(spark.range(40).selectExpr("CAST(id AS double) x"), "x") is None
    assert pl.fit_power_law(spark.range(100).selectExpr("CAST(-id AS double) x"), "x") is None


def test_zipf_beats_the_exponential(zipf):
    fit = pl.fit_power_law(zipf, "x")
    r = pl.compare_tails(zipf, fit, "exponential")
    assert r["ratio"] > 0 and 0 <= r["p"] < 0.05


def test_geometric_data_prefers_the_exponential(spark):
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(float(v),) for v in rng.geometric(0.05, 4000)], "x double")
    fit = pl.PowerLawFit("x", 4000, 4000, 1.0, 1.3, 0.0)
    r = pl.compare_tails(df, fit, "exponential")
    assert r["ratio"] < 0 and r["rate"] == pytest.approx(-np.log(0.95), rel=0.1)


def test_lognormal_parameters(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.lognormal(4.0, 0.5, 6000))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    fit = pl.PowerLawFit("x", len(x), len(x), 1.0, 1.3, 0.0)
    r = pl.compare_tails(df, fit, "lognormal")
    assert r["mu"] == pytest.approx(4.0, abs=0.05) and r["sigma"] == pytest.approx(0.5, abs=0.05) and r["ratio"] < 0
    with pytest.raises(ValueError):
        pl.compare_tails(df, fit, "cauchy")
