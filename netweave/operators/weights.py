"""Class weights, their evolution over rounds, and the focal loss."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SMALL = 1e-6  # Fixed value: added to class counts before dividing.


def class_weights(df: DataFrame, label: str, score: str | None = None, method: str = "balanced",
                  threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """``(class_id, weight)`` per class that occurs, optionally per group.

    ``balanced`` needs only the label.  ``focal_adaptive``, ``confidence_based`` and
    ``error_rate_based`` raise the weight of classes the score gets wrong;
    ``ratio`` is the negative-to-positive style {0: n1/n0, 1: 1}.
    """
    y, by = F.col(label), list(by)
    n = F.count("*").cast("double")
    if method in ("balanced", "ratio"):
        counts = df.groupBy(*by, y.alias("class_id")).agg(n.alias("_n"))
        # One row per class in the window.
        w = Window.partitionBy(*(by or [F.lit(0)]))
        if method == "balanced":
            weight = F.sum("_n").over(w) / (F.count("*").over(w) * F.col("_n"))
        else:
            ones = F.sum(F.when(F.col("class_id") == 1, F.col("_n"))).over(w)
            weight = F.when(F.col("class_id") == 1, F.lit(1.0)).otherwise(ones / F.col("_n"))
        return counts.select(*by, "class_id", weight.alias("weight"))
    if score is None:
        raise ValueError(f"{method} needs a score column")
    p = F.col(score)
    confidence = F.avg(F.when(y == 1, p).otherwise(F.lit(1.0) - p))
    wrong = F.avg((F.when(p > threshold, F.lit(1)).otherwise(F.lit(0)) != y).cast("double"))
    factor = {
        "focal_adaptive": F.lit(1.0) + (F.lit(1.0) - confidence) * F.lit(2.0),
        "confidence_based": F.lit(2.0) - confidence,
        "error_rate_based": F.lit(1.0) + wrong * F.lit(3.0),
    }[method]
    weight = F.lit(1.0) / (n + F.lit(_SMALL)) * factor
    return df.groupBy(*by, y.alias("class_id")).agg(weight.alias("weight"))


def scale_pos_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives over positives; null when there are no positives."""
    zero, one = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(F.try_divide(zero.cast("double"), one.cast("double")).alias("scale_pos_weight"))


def momentum_update(old: Mapping, new: Mapping, momentum: float = 0.9) -> dict:
    """One smoothing step over class weights; classes without history take the new value."""
    out = dict(old)
    for class_id, weight in new.items():
        out[class_id] = momentum * out[class_id] + (1.0 - momentum) * weight if class_id in out else weight
    return out


class WeightSchedule:
    """Decides in which rounds weights are refreshed.

    The counter advances every round.  ``legacy`` advances it only on an update,
    so that any frequency above one updates a single time.
    """

    def __init__(self, frequency: int = 1, legacy: bool = False):
        self.frequency, self.legacy, self._count = frequency, legacy, 0

    def step(self) -> bool:
        due = self._count % self.frequency == 0
        if due or not self.legacy:
            self._count += 1
        return due


def momentum_history(rounds: DataFrame, momentum: float = 0.9) -> DataFrame:
    """Smooth ``(round, class_id, weight)`` over rounds.

    The table has one row per round and class, so each class's series is short
    enough for one array fold.
    """
    series = rounds.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("round", "weight"))).alias("s"))
    start = F.struct(F.lit(None).cast("double").alias("last"),
                     F.array().cast("array<struct<round:bigint,weight:double>>").alias("out"))

    def fold(acc, x):
        value = F.when(acc["last"].isNull(), x["weight"]).otherwise(
            F.lit(momentum) * acc["last"] + F.lit(1.0 - momentum) * x["weight"])
        entry = F.struct(x["round"].cast("bigint").alias("round"), value.alias("weight"))
        return F.struct(value.alias("last"), F.concat(acc["out"], F.array(entry)).alias("out"))

    folded = series.select("class_id", F.explode(F.aggregate("s", start, fold)["out"]).alias("x"))
    return folded.select("x.round", "class_id", "x.weight")


def weights_evolution(history: DataFrame) -> DataFrame:
    """Per round: both class weights, their difference and ratio (1 against 0)."""
    def of(c):
        return F.max(F.when(F.col("class_id") == c, F.col("weight")))

    both = history.groupBy("round").agg(of(0).alias("weight_0"), of(1).alias("weight_1"))
    return both.select(
        "*", (F.col("weight_1") - F.col("weight_0")).alias("difference"),
        F.try_divide(F.col("weight_1"), F.col("weight_0")).alias("ratio"),
    )


def focal_loss(label: str, score: str, alpha: float = 0.25, gamma: float = 2.0,
               weights: Mapping | None = None) -> Column:
    """Per-row focal loss; average or add it up as needed.

    Logarithms are held at -100 or above, as binary cross entropy usually does.
    """
    y, p = F.col(label), F.col(score)
    at = F.when(y == 1, p).otherwise(F.lit(1.0) - p)
    cross = -F.greatest(F.when(at > 0, F.log(at)).otherwise(F.lit(-100.0)), F.lit(-100.0))
    loss = F.lit(alpha) * F.pow(F.lit(1.0) - at, F.lit(gamma)) * cross
    if weights:
        factor = F.lit(1.0)
        for class_id, weight in weights.items():
            factor = F.when(y == class_id, F.lit(float(weight))).otherwise(factor)
        loss = loss * factor
    return loss


def weight_map(weights: DataFrame) -> dict:
    """The ``(class_id, weight)`` table as a dictionary."""
    return {r["class_id"]: r["weight"] for r in weights.select("class_id", "weight").collect()}


def with_weight(df: DataFrame, label: str, weights: Mapping, out: str = "weight") -> DataFrame:
    """Add each row's class weight."""
    factor = F.lit(1.0)
    for class_id, weight in weights.items():
        factor = F.when(F.col(label) == class_id, F.lit(float(weight))).otherwise(factor)
    return df.withColumn(out, factor)
