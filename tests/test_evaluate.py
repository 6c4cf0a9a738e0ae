import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.operators import metrics as m
from netweave.operators import weights as w
from netweave.operators.calibrate import calibrate, fit_calibrator


@pytest.fixture(scope="module")
def weighting(spark):
    rows = list(zip([0, 0, 0, 0, 1], [.1, .2, .3, .6, .4]))
    return spark.createDataFrame(rows, "y int, p double")


@pytest.mark.parametrize("method,want", [
    ("balanced", (0.625, 2.5)), ("focal_adaptive", (0.3999999000, 2.1999978000)),
    ("confidence_based", (0.3249999188, 1.5999984000)), ("error_rate_based", (0.4374998906, 3.9999960000)),
    ("ratio", (0.25, 1.0)),
])
def test_weights_by_hand(weighting, method, want):
    got = w.weight_map(w.class_weights(weighting, "y", "p", method))
    assert (got[0], got[1]) == pytest.approx(want, abs=1e-9)


def test_score_is_required(weighting):
    with pytest.raises(ValueError):
        w.class_weights(weighting, "y", method="focal_adaptive")


def test_focal_loss_by_hand(weighting):
    assert weighting.agg(F.avg(w.focal_loss("y", "p"))).first()[0] == pytest.approx(0.0350904710, abs=1e-9)


def test_focal_loss_at_the_ends(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (0, 1.0)], "y int, p double")
    got = [r[0] for r in df.select(w.focal_loss("y", "p")).collect()]
    assert got == [25.0, 0.0, 25.0]


def test_momentum_and_schedule():
    assert w.momentum_update({}, {0: 1.0}) == {0: 1.0}
    assert w.momentum_update({0: 1.0}, {0: 2.0, 1: 5.0}) == {0: pytest.approx(1.1), 1: 5.0}
    due = w.WeightSchedule(2, legacy=True)
    assert [due.step() for _ in range(10)].count(True) == 1
    fixed = w.WeightSchedule(2)
    assert [fixed.step() for _ in range(10)].count(True) == 5


def test_scale_pos_weight(weighting):
    assert w.scale_pos_weight(weighting, "y").first()[0] == 4.0
    assert w.scale_pos_weight(weighting.where("y = 0"), "y").first()[0] is None


@pytest.fixture(scope="module")
def tied(spark):
    return spark.createDataFrame(list(zip([1, 1, 0, 1, 0, 0], [.9, .8, .8, .4, .4, .1])), "y int, s double")


def test_measures_by_hand(tied):
    r = m.evaluate(tied, "y", "s").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 2)
    assert r["auc"] == pytest.approx(0.7777777778)
    assert r["average_precision"] == pytest.approx(0.7555555556)
    assert r["mcc"] == pytest.approx(0.3333333333)
    assert m.metrics(tied, "y", "s").first()["f1"] == r["f1"] == pytest.approx(2 / 3)
    assert m.roc_auc(tied, "y", "s", rows_per_range=1).first()[0] == pytest.approx(0.7777777778)


def test_single_class(tied):
    r = m.evaluate(tied.where("y = 0"), "y", "s").first()
    assert (r["tp"], r["fn"]) == (0, 0) and r["auc"] is None and r["precision"] == 0.0
    assert m.evaluate(tied.where("y = 5"), "y", "s").first()["accuracy"] in (None, 0.0)


def test_curve_against_pairs(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 800), np.round(rng.random(800), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    for size in (7, 10**6):
        assert m.roc_auc(df, "y", "s", rows_per_range=size).first()[0] == pytest.approx(want)


def test_fold_mean(tied):
    df = tied.withColumn("f", F.when(F.col("s") > 0.5, 0).otherwise(1))
    rows = {r["fold"]: r for r in m.fold_metrics(df, "y", "s", "f").collect()}
    assert set(rows) == {"0", "1", "mean"}
    assert rows["mean"]["accuracy"] == pytest.approx((rows["0"]["accuracy"] + rows["1"]["accuracy"]) / 2)


def test_best_config_ties(spark):
    df = spark.createDataFrame([("b", .5, 3), ("a", .5, 4), ("c", .1, 3)], "n string, f1 double, nonzero int")
    r = m.best_config(df, "n").first()
    assert (r["best"], r["sparsest"]) == ("a", "b")


@pytest.fixture(scope="module")
def domains(spark):
    rng = np.random.default_rng(2)
    rows = []
    for d, (a, b) in {"tcp": (-5.0, 2.0), "udp": (-2.0, 0.5)}.items():
        for s in rng.random(4000):
            rows.append((d, float(round(s, 3)), int(rng.random() < 1 / (1 + math.exp(a * s + b)))))
    rows += [("icmp", 0.3, 1)] * 5
    return spark.createDataFrame(rows, "d string, s double, y int")


def test_platt_recovers_the_sigmoids(domains):
    fits = {r["domain"]: r for r in fit_calibrator(domains, "s", "y", "d").collect()}
    assert set(fits) == {"tcp", "udp"} and fits["tcp"]["rows"] == 4000
    assert fits["tcp"]["a"] == pytest.approx(-5.0, abs=0.4) and fits["tcp"]["b"] == pytest.approx(2.0, abs=0.25)
    assert fits["udp"]["a"] == pytest.approx(-2.0, abs=0.4)


def test_calibration_is_monotone_and_skips_small_domains(domains):
    out = calibrate(domains, fit_calibrator(domains, "s", "y", "d"), "s", "d")
    assert out.where("d = 'icmp' AND calibrated <> s").count() == 0
    points = [r["calibrated"] for r in out.where("d = 'tcp'").select("s", "calibrated").distinct().orderBy("s").collect()]
    assert points == sorted(points)


def test_separable_domain_stays_finite(spark):
    df = spark.createDataFrame([("d", i / 100, int(i >= 50)) for i in range(100)], "d string, s double, y int")
    r = fit_calibrator(df, "s", "y", "d").first()
    assert r["a"] < 0 and math.isfinite(r["a"]) and math.isfinite(r["b"])
