"""Platt calibration of scores, one sigmoid per domain.

Rows collapse to one per (domain, distinct score); each Newton step is then a
grouped sum over that table, with the current coefficients of a batch of domains joined
in.  No domain's rows are ever gathered in one place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.session import materialize, small_table

_STEPS = 100
#: Domains fitted together, and whose coefficients may travel to the rows.
_BATCH = 100_000


def sigmoid(a: Column, b: Column, s: Column) -> Column:
    """``1 / (1 + exp(a*s + b))``, computed without overflow."""
    z = a * s + b
    return F.when(z >= 0, F.exp(-z) / (F.lit(1.0) + F.exp(-z))).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(z)))


def _starts(counts: DataFrame, min_rows: int, batch: int, batches: int) -> list[dict]:
    """Where the fits of one batch of domains begin."""
    mine = counts.where(F.pmod(F.xxhash64(F.col("domain").cast("string")), F.lit(batches)) == batch)
    rows = mine.groupBy("domain").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(
        F.col("pos") + F.col("neg") >= min_rows).collect()
    return [
        {
            "domain": r["domain"], "a": 0.0, "b": math.log((r["neg"] + 1.0) / (r["pos"] + 1.0)),
            # Smoothed targets keep the fit finite when the classes separate.
            "high": (r["pos"] + 1.0) / (r["pos"] + 2.0), "low": 1.0 / (r["neg"] + 2.0),
            "rows": r["pos"] + r["neg"], "damp": 1e-12, "loss": None, "done": False,
        }
        for r in rows
    ]


def fit_calibrator(df: DataFrame, score: str, label: str, domain: str, min_rows: int = 10,
                   tolerance: float = 1e-10, per_batch: int = _BATCH) -> DataFrame:
    """``(domain, a, b, rows, converged)``; domains with fewer than ``min_rows`` rows are left out.

    The coefficients of about ``per_batch`` domains are on the driver at a time; more
    domains take further batches.  A fit that its steps did not bring to rest says so.
    """
    spark = df.sparkSession
    counts = materialize(
        df.groupBy(F.col(domain).alias("domain"), F.col(score).cast("double").alias("s")).agg(
            F.count_if(F.col(label) == 1).cast("double").alias("pos"),
            F.count_if(F.col(label) == 0).cast("double").alias("neg")),
        "score-counts",
    )
    batches = max(1, -(-counts.select("domain").distinct().count() // per_batch))
    out = None
    for batch in range(batches):
        fits = _fitted(spark, counts, _starts(counts, min_rows, batch, batches), tolerance)
        part = small_table(
            spark, [(str(f["domain"]), f["a"], f["b"], int(f["rows"]), f["done"]) for f in fits],
            "domain string, a double, b double, rows bigint, converged boolean")
        part = part if batches == 1 else materialize(part, "calibration")
        out = part if out is None else out.unionByName(part)
    return out


def _fitted(spark, counts: DataFrame, fits: list[dict], tolerance: float) -> list[dict]:
    schema = "domain string, a double, b double, high double, low double"
    for _ in range(_STEPS):
        active = [f for f in fits if not f["done"]]
        if not active:
            break
        current = small_table(
            spark,
            [(str(f["domain"]), f["a"], f["b"], f["high"], f["low"]) for f in active], schema)
        sums = _sums(counts, current)
        for f in active:
            _step(f, sums[str(f["domain"])], tolerance)
    return fits


def _sums(counts: DataFrame, current: DataFrame) -> dict:
    """Loss, gradient and curvature per domain at the current coefficients."""
    joined = counts.withColumn("domain", F.col("domain").cast("string")).join(F.broadcast(current), "domain")
    p = sigmoid(F.col("a"), F.col("b"), F.col("s"))
    z = F.col("a") * F.col("s") + F.col("b")
    n = F.col("pos") + F.col("neg")
    target = F.col("pos") * F.col("high") + F.col("neg") * F.col("low")
    slope = target - n * p
    curve = n * p * (F.lit(1.0) - p)
    softplus = F.when(z > 0, z + F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z)))
    loss = target * softplus + (n - target) * (softplus - z)
    rows = joined.groupBy("domain").agg(
        F.sum(loss).alias("loss"), F.sum(slope * F.col("s")).alias("ga"), F.sum(slope).alias("gb"),
        F.sum(curve * F.col("s") * F.col("s")).alias("aa"), F.sum(curve * F.col("s")).alias("ab"),
        F.sum(curve).alias("bb"),
    ).collect()
    return {r["domain"]: r for r in rows}


def _step(f: dict, r, tolerance: float) -> None:
    """A damped Newton step: a step that raised the loss is taken back and shortened."""
    if f["loss"] is not None and r["loss"] > f["loss"] + 1e-9 * abs(f["loss"]):
        f["a"], f["b"] = f["last"]
        f["shift"] = (f["shift"][0] / 2, f["shift"][1] / 2)
        f["a"], f["b"] = f["a"] + f["shift"][0], f["b"] + f["shift"][1]
        f["done"] = max(abs(x) for x in f["shift"]) < tolerance
        return
    f["loss"] = r["loss"]
    aa, bb, ab = r["aa"] + f["damp"], r["bb"] + f["damp"], r["ab"]
    det = aa * bb - ab * ab
    if det <= 0:
        f["done"] = True
        return
    # The loss falls along minus the inverse curvature times the slope.
    da = -(bb * r["ga"] - ab * r["gb"]) / det
    db = -(aa * r["gb"] - ab * r["ga"]) / det
    f["last"], f["shift"] = (f["a"], f["b"]), (da, db)
    f["a"], f["b"] = f["a"] + da, f["b"] + db
    f["done"] = max(abs(da), abs(db)) < tolerance


def calibrate(df: DataFrame, params: DataFrame, score: str, domain: str, out: str = "calibrated") -> DataFrame:
    """Add the calibrated score; rows of domains without a fit keep the raw one."""
    fits = params.select(F.col("domain").alias("_domain"), "a", "b")
    fits = F.broadcast(fits) if fits.count() <= _BATCH else fits
    joined = df.join(fits, F.col(domain).cast("string") == F.col("_domain"), "left")
    value = F.coalesce(sigmoid(F.col("a"), F.col("b"), F.col(score)), F.col(score))
    return joined.select(*df.columns, value.alias(out))
