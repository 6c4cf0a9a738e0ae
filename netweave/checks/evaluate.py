"""Weights, losses and evaluation measures over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.checks.base import SCORES, query, rounded, scores
from netweave.operators import metrics as m
from netweave.operators import weights as w
from netweave.operators.augment import mask_probability
from netweave.operators.calibrate import calibrate, fit_calibrator
from netweave.operators.models import mean_score
from netweave.session import small_table

# --- class weights ---------------------------------------------------------------------


@query("scale_pos_weight", f"""
WITH {SCORES}
SELECT round(count(*) FILTER (label = 0)::DOUBLE / count(*) FILTER (label = 1), 6) AS scale_pos_weight FROM scores
""")
def scale_pos_weight(spark, sf):
    return rounded(w.scale_pos_weight(scores(spark, sf), "label"))


@query("weights_balanced", f"""
WITH {SCORES}
SELECT label AS class_id, round((SELECT count(*) FROM scores) / (2.0::DOUBLE * count(*)), 6) AS weight FROM scores GROUP BY label
""")
def weights_balanced(spark, sf):
    return rounded(w.class_weights(scores(spark, sf), "label"))


@query("weights_ratio", f"""
WITH {SCORES}
SELECT 1 AS class_id, 1.0::DOUBLE AS weight UNION ALL
SELECT 0, round(count(*) FILTER (label = 1)::DOUBLE / count(*) FILTER (label = 0), 6) FROM scores
""")
def weights_ratio(spark, sf):
    return rounded(w.class_weights(scores(spark, sf), "label", method="ratio"))


def _weights_sql(factor):
    return f"""
WITH {SCORES}
SELECT label AS class_id, round(1000 * (1.0::DOUBLE / (count(*) + 0.000001::DOUBLE)) * ({factor}), 6) AS weight FROM scores GROUP BY label
"""


_CONFIDENCE = "avg(CASE WHEN label = 1 THEN score ELSE 1 - score END)"


def _weights(spark, sf, method):
    out = w.class_weights(scores(spark, sf), "label", "score", method)
    # Weights are near 1/n; scale before rounding.
    return out.select("class_id", F.round(F.col("weight") * 1000, 6).alias("weight"))


@query("weights_focal", _weights_sql(f"1 + 2 * (1 - {_CONFIDENCE})"))
def weights_focal(spark, sf):
    return _weights(spark, sf, "focal_adaptive")


@query("weights_confidence", _weights_sql(f"2 - {_CONFIDENCE}"))
def weights_confidence(spark, sf):
    return _weights(spark, sf, "confidence_based")


@query("weights_error", _weights_sql("1 + 3 * avg(CAST((score > 0.5) <> (label = 1) AS DOUBLE))"))
def weights_error(spark, sf):
    return _weights(spark, sf, "error_rate_based")


def rounds(spark, sf):
    """Weights of ten rounds of rows."""
    df = scores(spark, sf).withColumn("round", F.pmod("row_id", F.lit(10)))
    out = w.class_weights(df, "label", "score", "focal_adaptive", by=("round",))
    return out.withColumn("weight", F.col("weight") * 1000)


ROUNDS = SCORES + f""", rounds AS (
  SELECT row_id % 10 AS round, label AS class_id,
    1000 * (1.0::DOUBLE / (count(*) + 0.000001::DOUBLE)) * (1 + 2 * (1 - {_CONFIDENCE})) AS weight
  FROM scores GROUP BY 1, 2),
smooth AS (
  SELECT r.round, r.class_id, sum(p.weight * CASE WHEN p.round = 0 THEN power(0.9::DOUBLE, r.round)
    ELSE 0.1::DOUBLE * power(0.9::DOUBLE, r.round - p.round) END) AS weight
  FROM rounds r JOIN rounds p ON p.class_id = r.class_id AND p.round <= r.round GROUP BY 1, 2)"""


@query("weights_momentum", f"WITH {ROUNDS} SELECT round, class_id, round(weight, 6) AS weight FROM smooth")
def weights_momentum(spark, sf):
    return rounded(w.momentum_history(rounds(spark, sf)))


@query("weights_evolution", f"""
WITH {ROUNDS}
SELECT a.round, round(a.weight, 6) AS weight_0, round(b.weight, 6) AS weight_1,
  round(b.weight - a.weight, 6) AS difference, round(b.weight / a.weight, 6) AS ratio
FROM smooth a JOIN smooth b ON a.round = b.round AND a.class_id = 0 AND b.class_id = 1
""")
def weights_evolution(spark, sf):
    return rounded(w.weights_evolution(w.momentum_history(rounds(spark, sf))))


@query("focal_loss", f"""
WITH {SCORES}, p AS (SELECT label, CASE WHEN label = 1 THEN score ELSE 1 - score END AS pt, score FROM scores),
l AS (SELECT label, 0.25 * power(1 - pt, 2) * least(CASE WHEN pt > 0 THEN -ln(pt) ELSE 100 END, 100) AS loss, score FROM p)
SELECT round(avg(loss), 6) AS mean_loss, round(sum(loss), 3) AS total_loss,
  round(avg(loss * CASE WHEN label = 1 THEN 3 ELSE 1 END), 6) AS weighted_loss,
  round(avg(CAST((score > 0.5) = (label = 1) AS DOUBLE)), 6) AS accuracy FROM l
""")
def focal(spark, sf):
    df = scores(spark, sf)
    loss = w.focal_loss("label", "score")
    return df.agg(
        F.round(F.avg(loss), 6).alias("mean_loss"), F.round(F.sum(loss), 3).alias("total_loss"),
        F.round(F.avg(w.focal_loss("label", "score", weights={0: 1, 1: 3})), 6).alias("weighted_loss"),
        F.round(F.avg((m.decide("score") == F.col("label")).cast("double")), 6).alias("accuracy"))


@query("mask_schedule", f"""
WITH {SCORES}, e AS (SELECT row_id, row_id % 50 AS epoch FROM scores)
SELECT epoch, count(*) AS rows,
  round(any_value(CASE WHEN epoch < 10 THEN 0.05 WHEN epoch < 30 THEN 0.05 + (epoch - 9) * 0.005 ELSE 0.15 END)::DOUBLE, 6) AS a,
  round(any_value(CASE WHEN epoch < 10 THEN 0.05 WHEN epoch < 30 THEN 0.05 + (epoch - 10) * 0.0075 ELSE 0.2 END)::DOUBLE, 6) AS b
FROM e GROUP BY epoch
""")
def mask_schedule(spark, sf):
    e = scores(spark, sf).select(F.pmod("row_id", F.lit(50)).alias("epoch")).groupBy("epoch").agg(F.count("*").alias("rows"))
    return rounded(e.withColumns({"a": mask_probability(F.col("epoch"), "a"), "b": mask_probability(F.col("epoch"), "b")}))


# --- threshold measures -----------------------------------------------------------------

def _confusion_sql(by="", where="", threshold=0.5, op=">"):
    first = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {first}count(*) FILTER (label = 1 AND score {op} {threshold}) AS tp,
  count(*) FILTER (label = 1 AND NOT score {op} {threshold}) AS fn,
  count(*) FILTER (label = 0 AND score {op} {threshold}) AS fp,
  count(*) FILTER (label = 0 AND NOT score {op} {threshold}) AS tn FROM scores {where} {group}"""


CONFUSION = SCORES + f", c AS ({_confusion_sql()})"
_RATES = {
    "accuracy": "round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6)",
    "precision": "CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp)::DOUBLE, 6) END",
    "recall": "CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn)::DOUBLE, 6) END",
    "f1": "CASE WHEN tp = 0 THEN 0 ELSE round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) END",
}


def _rates(*names):
    return ", ".join(f"{_RATES[n]} AS {n}" for n in names)


@query("confusion_matrix", f"WITH {SCORES} {_confusion_sql()}")
def confusion_matrix(spark, sf):
    df = scores(spark, sf)
    return m.confusion(df.withColumn("pred", m.decide("score")), "label", "pred")


@query("classification_metrics", f"WITH {CONFUSION} SELECT {_rates('accuracy', 'precision', 'recall', 'f1')} FROM c")
def classification_metrics(spark, sf):
    return rounded(m.metrics(scores(spark, sf), "label", "score").select("accuracy", "precision", "recall", "f1"))


@query("mcc", f"""
WITH {CONFUSION}
SELECT round((tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c
""")
def mcc(spark, sf):
    return rounded(m.metrics(scores(spark, sf), "label", "score").select("mcc"))


@query("detection_rates", f"""
WITH {CONFUSION}
SELECT round(tp / (tp + fn)::DOUBLE, 6) AS detection_rate, round(fp / (fp + tn)::DOUBLE, 6) AS false_positive_rate FROM c
""")
def detection_rates(spark, sf):
    return rounded(m.metrics(scores(spark, sf), "label", "score").select("detection_rate", "false_positive_rate"))


@query("macro_metrics", f"""
WITH {SCORES}, p AS (SELECT domain AS label, CASE WHEN score > 0.8 THEN 'SF' WHEN score > 0.2 THEN 'S0' ELSE 'other' END AS pred FROM scores),
k AS (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT pred FROM p),
n AS (SELECT c, count(*) FILTER (label = c AND pred = c) AS hit, count(*) FILTER (label = c) AS actual,
  count(*) FILTER (pred = c) AS called FROM p, k GROUP BY c)
SELECT count(*) AS classes, round(avg(CASE WHEN called = 0 THEN 0 ELSE hit / called::DOUBLE END), 6) AS macro_precision,
  round(avg(CASE WHEN actual = 0 THEN 0 ELSE hit / actual::DOUBLE END), 6) AS macro_recall,
  round(avg(2 * hit / (actual + called)::DOUBLE), 6) AS macro_f1 FROM n
""")
def macro(spark, sf):
    df = scores(spark, sf).select(
        F.col("domain").alias("label"),
        F.when(F.col("score") > 0.8, "SF").when(F.col("score") > 0.2, "S0").otherwise("other").alias("pred"))
    return rounded(m.macro_metrics(df, "label", "pred"))


@query("threshold_apply", f"""
WITH {SCORES}
SELECT row_id, CAST(score > 0.5 AS INTEGER) AS at_half, CAST(score > 0.8 AS INTEGER) AS at_high,
  CAST(score >= 0.5 AS INTEGER) AS at_half_inclusive FROM scores
""")
def threshold_apply(spark, sf):
    return scores(spark, sf).select("row_id", m.decide("score").alias("at_half"), m.decide("score", 0.8).alias("at_high"),
                                    m.decide("score", inclusive=True).alias("at_half_inclusive"))


@query("stack_scores", f"""
WITH {SCORES}, b AS (
  SELECT row_id, label, score AS p_a, round(score * score, 6) AS p_b, round(1 - score, 6) AS p_c, round(score / 2, 6) AS p_d FROM scores)
SELECT row_id, label, p_a, p_b, p_c, p_d, round((p_a + p_b + p_c + p_d) / 4, 6) AS score,
  CAST((p_a + p_b + p_c + p_d) / 4 > 0.5 AS INTEGER) AS pred FROM b
""")
def stack_scores(spark, sf):
    """Scores kept as separate tables are bound by key; their mean stands in for a meta model."""
    s = scores(spark, sf).select("row_id", "label", "score")
    p = F.col("score")
    others = s.select("row_id", F.round(p * p, 6).alias("p_b"), F.round(F.lit(1.0) - p, 6).alias("p_c"),
                      F.round(p / 2, 6).alias("p_d"))
    bound = s.withColumnRenamed("score", "p_a").join(others, "row_id")
    mean = mean_score(["p_a", "p_b", "p_c", "p_d"])
    return bound.withColumns({"score": F.round(mean, 6), "pred": m.decide(mean)})


# --- curves -------------------------------------------------------------------------------

CURVE = SCORES + """, s AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scores GROUP BY 1),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
total AS (SELECT sum(pos) AS p, sum(neg) AS n FROM s)"""


@query("roc_curve", f"WITH {CURVE} SELECT score, round(fp / n::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr FROM cum, total")
def roc_curve(spark, sf):
    return rounded(m.roc_curve(scores(spark, sf), "label", "score"))


@query("roc_curve_ranged", f"WITH {CURVE} SELECT score, round(fp / n::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr FROM cum, total")
def roc_curve_ranged(spark, sf):
    """The same curve through the score ranges used for curves of any size."""
    return rounded(m.roc_curve(scores(spark, sf), "label", "score", rows_per_range=100))


_AUC = "sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE)"


@query("roc_auc", f"WITH {CURVE} SELECT round({_AUC}, 6) AS auc FROM cum")
def roc_auc(spark, sf):
    return rounded(m.roc_auc(scores(spark, sf), "label", "score"))


@query("average_precision", f"""
WITH {CURVE} SELECT round(sum(pos * (tp / (tp + fp)::DOUBLE)) / sum(pos), 6) AS average_precision FROM cum
""")
def average_precision(spark, sf):
    return rounded(m.average_precision(scores(spark, sf), "label", "score"))


def _grouped_curve(by, source="scores", score="score"):
    return f"""s AS (SELECT {by}, {score} AS score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {source} GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
auc AS (SELECT {by}, {_AUC} AS auc, sum(pos * (tp / (tp + fp)::DOUBLE)) / sum(pos) AS ap FROM cum GROUP BY 1)"""


@query("fold_metrics", f"""
WITH {SCORES}, {_grouped_curve("fold")}, c AS ({_confusion_sql("fold")}),
f AS (SELECT fold::VARCHAR AS fold, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, tp / (tp + fp)::DOUBLE AS precision,
  tp / (tp + fn)::DOUBLE AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, auc FROM c JOIN auc USING (fold))
SELECT fold, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round(auc, 6) AS auc FROM f
UNION ALL SELECT 'mean', round(avg(accuracy), 6), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), round(avg(auc), 6) FROM f
""")
def fold_metrics(spark, sf):
    return rounded(m.fold_metrics(scores(spark, sf), "label", "score", "fold"))


_FIXED = {"SF": (-6.0, 3.0), "S0": (-4.0, 2.5)}  # a, b per calibrated domain; the third one stays raw

CALIBRATED = SCORES + """, calibrated AS (SELECT row_id, label, domain, score, CASE domain """ + " ".join(
    f"WHEN '{d}' THEN round(1 / (1 + exp({a} * score + {b})), 6)" for d, (a, b) in _FIXED.items()) + " ELSE score END AS calibrated FROM scores)"


def _fixed_calibration(spark, sf):
    params = small_table(spark, [(d, a, b, 1) for d, (a, b) in _FIXED.items()], "domain string, a double, b double, rows bigint")
    out = calibrate(scores(spark, sf), params, "score", "domain")
    # Six digits keep equal scores equal in either engine.
    return out.withColumn("calibrated", F.round("calibrated", 6))


@query("calibrate_apply", f"WITH {CALIBRATED} SELECT row_id, domain, round(calibrated, 6) AS calibrated FROM calibrated")
def calibrate_apply(spark, sf):
    return rounded(_fixed_calibration(spark, sf).select("row_id", "domain", "calibrated"))


@query("calibrate_fit", f"""
WITH RECURSIVE {SCORES}, g AS (SELECT domain, score AS s, count(*) FILTER (label = 1)::DOUBLE AS pos, count(*) FILTER (label = 0)::DOUBLE AS neg
  FROM scores GROUP BY 1, 2),
n AS (SELECT domain, sum(pos) AS p, sum(neg) AS q FROM g GROUP BY 1),
t AS (SELECT domain, (p + 1) / (p + 2) AS hi, 1 / (q + 2) AS lo, ln((q + 1) / (p + 1)) AS b0, (p + q)::BIGINT AS rows FROM n),
fit(i, domain, a, b) AS (
  SELECT 0, domain, 0.0::DOUBLE, b0 FROM t
  UNION ALL
  SELECT i + 1, domain, a - (bb * ga - ab * gb) / (aa * bb - ab * ab), b - (aa * gb - ab * ga) / (aa * bb - ab * ab) FROM (
    SELECT i, domain, a, b, sum(e * s) AS ga, sum(e) AS gb, sum(h * s * s) AS aa, sum(h * s) AS ab, sum(h) AS bb FROM (
      SELECT f.i, f.domain, f.a, f.b, g.s, g.pos * t.hi + g.neg * t.lo - (g.pos + g.neg) / (1 + exp(f.a * g.s + f.b)) AS e,
        (g.pos + g.neg) / (1 + exp(f.a * g.s + f.b)) * (1 - 1 / (1 + exp(f.a * g.s + f.b))) AS h
      FROM fit f JOIN g ON g.domain = f.domain JOIN t ON t.domain = f.domain WHERE f.i < 20)
    GROUP BY i, domain, a, b))
SELECT domain, round(a, 5) AS a, round(b, 5) AS b, rows, true AS converged FROM fit JOIN t USING (domain) WHERE i = 20
""")
def calibrate_fit(spark, sf):
    return rounded(fit_calibrator(scores(spark, sf), "score", "label", "domain"), 5)


@query("raw_vs_calibrated", f"""
WITH {CALIBRATED}, both_kinds AS (SELECT 'score' AS kind, label, score FROM calibrated UNION ALL SELECT 'calibrated', label, calibrated FROM calibrated),
{_grouped_curve("kind", "both_kinds")}, c AS ({_confusion_sql("kind").replace("FROM scores", "FROM both_kinds")})
SELECT kind, {_rates('accuracy', 'precision', 'recall', 'f1')}, round(auc, 6) AS auc, round(ap, 6) AS average_precision FROM c JOIN auc USING (kind)
""")
def raw_vs_calibrated(spark, sf):
    out = m.compare_scores(_fixed_calibration(spark, sf), "label", ["score", "calibrated"])
    return rounded(out.select("kind", "accuracy", "precision", "recall", "f1", "auc", "average_precision"))


@query("overfit_gap", f"""
WITH {SCORES}, c AS ({_confusion_sql("domain, split")}),
r AS (SELECT domain, split, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM c),
g AS (SELECT domain, a.accuracy - b.accuracy AS accuracy_gap, a.f1 - b.f1 AS f1_gap FROM r a JOIN r b USING (domain)
  WHERE a.split = 'train' AND b.split = 'test')
SELECT domain, round(accuracy_gap, 6) AS accuracy_gap, round(f1_gap, 6) AS f1_gap,
  CASE WHEN accuracy_gap > 0.1 OR f1_gap > 0.1 THEN 'overfit' WHEN accuracy_gap < 0.02 AND f1_gap < 0.02 THEN 'good' ELSE 'tune' END AS verdict FROM g
""")
def overfit_gap(spark, sf):
    parts = m.metrics(scores(spark, sf), "label", "score", by=["domain", "split"])
    return rounded(m.overfit_gap(parts.where("split = 'train'"), parts.where("split = 'test'"), ["domain"]))


_THRESHOLDS = (0.1, 0.3, 0.5, 0.7, 0.9)


@query("best_config", f"""
WITH {SCORES}, c AS (SELECT t, count(*) FILTER (label = 1 AND score > t) AS tp, count(*) FILTER (label = 1 AND score <= t) AS fn,
    count(*) FILTER (label = 0 AND score > t) AS fp
  FROM scores, (SELECT unnest([{", ".join(str(t) for t in _THRESHOLDS)}])::DOUBLE AS t) GROUP BY t),
r AS (SELECT t::VARCHAR AS config, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, tp + fp AS called FROM c)
SELECT (SELECT config FROM r ORDER BY f1 DESC, config LIMIT 1) AS best, round(max(f1), 6) AS best_score,
  (SELECT config FROM r ORDER BY called, config LIMIT 1) AS sparsest, min(called) AS sparsest_size FROM r
""")
def best_config(spark, sf):
    """Thresholds as configurations: best by F1, sparsest by alarms raised."""
    cuts = F.array(*[F.lit(t) for t in _THRESHOLDS])
    tall = scores(spark, sf).select("label", "score", F.explode(cuts).alias("t"))
    called = tall.withColumn("pred", (F.col("score") > F.col("t")).cast("int"))
    results = m.rates(m.confusion(called, "label", "pred", ["t"])).select(
        F.col("t").cast("string").alias("config"), "f1", (F.col("tp") + F.col("fp")).alias("called"))
    return rounded(m.best_config(results, "config", "f1", "called"))
