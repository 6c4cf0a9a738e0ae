"""Evaluation measures over (label, score) rows, overall or per group.

Threshold measures are single aggregates.  Curve measures first collapse the
rows to one per distinct score, then run prefix sums over score ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.operators.ordering import ROWS_PER_RANGE, prefix_sums
from netweave.session import materialize


def decide(score: str | Column, threshold: float = 0.5, inclusive: bool = False) -> Column:
    """0/1 decision at a threshold."""
    s = F.col(score) if isinstance(score, str) else score
    hit = s >= F.lit(threshold) if inclusive else s > F.lit(threshold)
    return hit.cast("int")


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fn, fp, tn.  All four exist even when only one class occurs."""
    y, p = F.col(label), F.col(pred)
    counts = [
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    ]
    return df.groupBy(*by).agg(*counts) if by else df.agg(*counts)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, MCC, detection and false-positive rate from confusion counts."""
    tp, fn, fp, tn = (F.col(c).cast("double") for c in ("tp", "fn", "fp", "tn"))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.select(
        "*",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp * tn - fp * fn, spread).alias("mcc"),
        _ratio(tp, tp + fn).alias("detection_rate"),
        _ratio(fp, fp + tn).alias("false_positive_rate"),
    )


def metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5, by: Sequence[str] = (),
            inclusive: bool = False) -> DataFrame:
    """Confusion counts and all threshold measures."""
    return rates(confusion(df.withColumn("_pred", decide(score, threshold, inclusive)), label, "_pred", by))


def macro_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall and F1 averaged over the classes that occur as label or prediction."""
    pair = F.array(
        F.struct(F.col(label).alias("class"), (F.col(label) == F.col(pred)).cast("int").alias("hit"),
                 F.lit(1).alias("actual"), F.lit(0).alias("called")),
        F.struct(F.col(pred).alias("class"), F.lit(0).alias("hit"), F.lit(0).alias("actual"), F.lit(1).alias("called")),
    )
    # Pre-aggregate the (label, prediction) pairs, so only class pairs are exploded.
    pairs = df.groupBy(label, pred).agg(F.count("*").alias("_n"))
    per_class = (
        pairs.select("_n", F.explode(pair).alias("x"))
        .groupBy("x.class")
        .agg(*[F.sum(F.col("_n") * F.col(f"x.{c}")).alias(c) for c in ("hit", "actual", "called")])
    )
    return per_class.agg(
        F.avg(_ratio(F.col("hit"), F.col("called"))).alias("macro_precision"),
        F.avg(_ratio(F.col("hit"), F.col("actual"))).alias("macro_recall"),
        F.avg(_ratio(2 * F.col("hit"), F.col("actual") + F.col("called"))).alias("macro_f1"),
        F.count("*").alias("classes"),
    )


def _cumulative(df: DataFrame, label: str, score: str, by: Sequence[str], rows_per_range: int) -> DataFrame:
    """Per distinct score: positives, negatives and their totals at or above it."""
    by = list(by)
    # Written, so that the rows behind it are scored once; one row per score that occurs.
    per_score = materialize(df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")), "score-counts")
    return prefix_sums(per_score, "score", {"tp": "pos", "fp": "neg"}, by, descending=True,
                       rows_per_range=rows_per_range)


def roc_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = (),
              rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(score, fpr, tpr) for every distinct score, used as an inclusive threshold."""
    by = list(by)
    points = _cumulative(df, label, score, by, rows_per_range)
    sums = [F.sum("pos").alias("_p"), F.sum("neg").alias("_n")]
    if by:
        joined = points.join(points.groupBy(*by).agg(*sums), by)
    else:
        row = points.agg(*sums).first()
        joined = points.withColumns({"_p": F.lit(row["_p"]), "_n": F.lit(row["_n"])})
    return joined.select(*by, "score", _ratio(F.col("fp"), F.col("_n")).alias("fpr"),
                         _ratio(F.col("tp"), F.col("_p")).alias("tpr"))


def _auc() -> Column:
    """Trapezoid area from the cumulative table; ties count half, one class gives null."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    return F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg").cast("double"))


def _average_precision() -> Column:
    step = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return F.try_divide(step, F.sum("pos").cast("double"))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (),
            rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Area under the ROC curve."""
    return _cumulative(df, label, score, by, rows_per_range).groupBy(*by).agg(_auc().alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = (),
                      rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Step-wise area under the precision-recall curve."""
    points = _cumulative(df, label, score, by, rows_per_range)
    return points.groupBy(*by).agg(_average_precision().alias("average_precision"))


def evaluate(df: DataFrame, label: str, score: str, threshold: float = 0.5, by: Sequence[str] = (),
             rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Threshold measures, AUC and average precision from one table of score counts."""
    points = _cumulative(df, label, score, by, rows_per_range)
    called = F.col("score") > F.lit(threshold)

    def total(c, test):
        return F.sum(F.when(test, F.col(c)).otherwise(F.lit(0)))

    counts = points.groupBy(*by).agg(
        total("pos", called).alias("tp"), total("pos", ~called).alias("fn"),
        total("neg", called).alias("fp"), total("neg", ~called).alias("tn"),
        _auc().alias("auc"), _average_precision().alias("average_precision"),
    )
    return rates(counts)


def fold_metrics(df: DataFrame, label: str, score: str, fold: str, threshold: float = 0.5) -> DataFrame:
    """Measures per fold plus a row with their mean (fold ``mean``)."""
    names = ("accuracy", "precision", "recall", "f1", "auc")
    per_fold = evaluate(df, label, score, threshold, [fold]).select(F.col(fold).cast("string").alias("fold"), *names)
    # A rollup over the fold rows gives the mean without computing them twice.
    return (
        per_fold.rollup("fold").agg(*[F.avg(c).alias(c) for c in names])
        .select(F.coalesce("fold", F.lit("mean")).alias("fold"), *names)
    )


def compare_scores(df: DataFrame, label: str, scores: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """The same measures for several score columns side by side."""
    kinds = F.array(*[F.struct(F.lit(s).alias("kind"), F.col(s).alias("value")) for s in scores])
    tall = df.select(label, F.explode(kinds).alias("x")).select(label, "x.*")
    return evaluate(tall, label, "value", threshold, ["kind"])


def overfit_gap(train: DataFrame, test: DataFrame, by: Sequence[str]) -> DataFrame:
    """Train minus test accuracy and F1 with a verdict."""
    by = list(by)
    pairs = train.select(*by, F.col("accuracy").alias("_a"), F.col("f1").alias("_f")).join(
        test.select(*by, "accuracy", "f1"), by)
    acc, f1 = F.col("_a") - F.col("accuracy"), F.col("_f") - F.col("f1")
    verdict = (
        F.when((acc > 0.1) | (f1 > 0.1), "overfit").when((acc < 0.02) & (f1 < 0.02), "good").otherwise("tune")
    )
    return pairs.select(*by, acc.alias("accuracy_gap"), f1.alias("f1_gap"), verdict.alias("verdict"))


def best_config(results: DataFrame, name: str, score: str = "f1", size: str = "nonzero") -> DataFrame:
    """The best and the sparsest configuration; ties go to the smaller name."""
    return results.agg(
        F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("n")))["n"].alias("best"),
        F.max(score).alias("best_score"),
        F.min(F.struct(F.col(size).alias("s"), F.col(name).alias("n")))["n"].alias("sparsest"),
        F.min(size).alias("sparsest_size"),
    )
