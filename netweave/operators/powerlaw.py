"""Discrete power-law fits and comparisons with other tails.

Everything works on the table of distinct values and their counts.  Exponents of
all candidate cut-offs come from prefix sums over it.  The Kolmogorov-Smirnov
distance is found by bounding: a short grid of values gives every cut-off a lower
and an upper bound, and only cut-offs that could still win are measured against
all values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.functions.numeric import hurwitz_zeta
from netweave.operators.ordering import prefix_sums
from netweave.session import materialize

_GRID = 96
_MAX_GRID = 6144
_PAIRS = 4_000_000  # (cut-off, value) pairs measured by one pass,
_LEAST = 16  # but at least so many cut-offs


@dataclass(frozen=True)
class PowerLawFit:
    column: str
    rows: int
    tail_rows: int
    xmin: float
    alpha: float
    distance: float


def fit_power_law(df: DataFrame, col: str, min_n: int = 50) -> PowerLawFit | None:
    """Exponent and cut-off of the best-fitting tail of the positive values; None below ``min_n`` rows or without such a tail."""
    x = F.col(col).cast("double")
    counts = df.where(x > 0).groupBy(x.alias("x")).agg(F.count("*").alias("n")).withColumn(
        "nlog", F.col("n") * F.log("x"))
    values = materialize(prefix_sums(counts, "x", {"tail": "n", "tail_log": "nlog"}, descending=True), "value-counts")
    size = values.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.max("x").alias("top")).first()
    if not size["n"] or size["n"] < min_n or size["v"] < 2:
        return None
    # Every value but the largest is a candidate cut-off.
    alpha = F.lit(1.0) + F.col("tail") / (F.col("tail_log") - F.col("tail") * F.log(F.col("x") - F.lit(0.5)))
    cuts = values.where((F.col("x") < size["top"]) & (F.col("x") > 0.5)).select(
        F.col("x").alias("xmin"), "tail", alpha.alias("alpha"))
    cuts = cuts.where(F.col("alpha") > 1.0).withColumn("z", hurwitz_zeta(F.col("alpha"), F.col("xmin")))
    batch = max(_LEAST, _PAIRS // size["v"])
    if batch >= size["v"]:
        best = _best(_measure(values, cuts.collect()))
    else:
        cuts, points = materialize(cuts, "cut-offs"), _GRID
        while True:
            survivors = _bounded(cuts, _grid(values, size["v"], points), size["top"])
            # The winner always survives; when many do, a finer grid separates them.
            if points >= _MAX_GRID or survivors.count() <= 4 * batch:
                break
            points *= 4
        best = _nearest(values, survivors, batch)
    if best is None:
        return None
    return PowerLawFit(col, int(size["n"]), int(best[1]), best[0], best[2], best[3])


def _best(measured, best=None):
    """The least distance; equal ones go to the smaller cut-off."""
    return min([*measured, *([best] if best else [])], key=lambda m: (m[3], m[0]), default=None)


def _nearest(values: DataFrame, survivors: DataFrame, batch: int):
    """The best of the cut-offs in a table, the most promising ones first, ``batch`` of them at a time.

    A cut-off whose least possible distance is above one already measured is out.
    """
    best, last = None, None
    while True:
        rest = survivors
        if best is not None:
            rest = rest.where(F.col("low") <= best[3] + 1e-12)
            rest = rest.where((F.col("low") > last["low"]) | ((F.col("low") == last["low"]) & (F.col("xmin") > last["xmin"])))
        part = rest.orderBy("low", "xmin").limit(batch).collect()
        if not part:
            return best
        best, last = _best(_measure(values, part), best), part[-1]


def _grid(values: DataFrame, size: int, points: int) -> list[tuple[float, int]]:
    """Up to ``points`` values spread evenly over the distinct ones, with the rows at or above each."""
    probs = [i / points for i in range(points + 1)]
    at = values.agg(F.percentile_approx("x", probs, 20 * points).alias("q")).first()["q"]
    return [(r["x"], r["tail"]) for r in values.where(F.col("x").isin(*sorted(set(at)))).orderBy("x").collect()]


def _bounded(cuts: DataFrame, grid, top: float) -> DataFrame:
    """Cut-offs whose smallest possible distance does not exceed the smallest certain one.

    Between two grid values both survival functions only fall, so their gap stays
    within the larger of the two crosswise differences.
    """
    points = F.expr("array(" + ",".join(f"named_struct('x', {x!r}D, 'n', {float(n)!r}D)" for x, n in grid) + ")")
    beyond = F.filter(points, lambda p: p["x"] > F.col("xmin"))

    def at(p):
        expected = hurwitz_zeta(F.col("alpha"), p["x"]) / F.col("z")
        return F.struct((p["n"] / F.col("tail")).alias("e"), expected.alias("t"))

    def end(v):
        return F.array(F.struct(F.lit(v).alias("e"), F.lit(v).alias("t")))

    walk = F.concat(end(1.0), F.transform(beyond, at))
    pairs = cuts.withColumn("w", walk)
    low = F.array_max(F.transform("w", lambda p: F.abs(p["e"] - p["t"])))
    # Past the last grid value both functions lie between 0 and their value there.
    following = F.concat(F.slice("w", 2, F.size("w")), end(0.0))
    high = F.array_max(F.zip_with("w", following, lambda p, q: F.greatest(p["e"] - q["t"], p["t"] - q["e"])))
    bounds = materialize(pairs.select("xmin", "tail", "alpha", "z", low.alias("low"), F.greatest(low, high).alias("high")),
                         "distance-bounds")
    limit = bounds.agg(F.min("high").alias("h")).first()["h"]
    return bounds if limit is None else bounds.where(F.col("low") <= limit + 1e-12)


def _measure(values: DataFrame, cuts) -> list[tuple[float, int, float, float]]:
    """Exact distances of a bounded number of cut-offs in one pass over the distinct values."""
    if not cuts:
        return []
    literal = F.expr("array(" + ",".join(
        f"named_struct('i', {i}, 'xmin', {c['xmin']!r}D, 't', {float(c['tail'])!r}D, 'a', {c['alpha']!r}D, 'z', {c['z']!r}D)"
        for i, c in enumerate(cuts)) + ")")
    tall = values.withColumn("c", F.explode(F.filter(literal, lambda c: c["xmin"] <= F.col("x"))))
    gap = F.abs(F.col("tail") / F.col("c.t") - hurwitz_zeta(F.col("c.a"), F.col("x")) / F.col("c.z"))
    found = {r["i"]: r["d"] for r in tall.groupBy(F.col("c.i").alias("i")).agg(F.max(gap).alias("d")).collect()}
    return [(c["xmin"], c["tail"], c["alpha"], found[i]) for i, c in enumerate(cuts)]


# --- other tails -------------------------------------------------------------------

def _tail(df: DataFrame, fit: PowerLawFit) -> DataFrame:
    x = F.col(fit.column).cast("double")
    return materialize(df.where(x >= fit.xmin).groupBy(x.alias("x")).agg(F.count("*").alias("n")), "tail")


def _power_law_log(fit: PowerLawFit) -> Column:
    norm = hurwitz_zeta(F.lit(fit.alpha), F.lit(fit.xmin))
    return F.lit(-fit.alpha) * F.log("x") - F.log(norm)


def fit_exponential(tail: DataFrame, xmin: float) -> float:
    """Rate of the discrete exponential tail; its likelihood has a closed-form peak."""
    mean = tail.agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m")).first()["m"]
    return math.log1p(1.0 / (mean - xmin)) if mean > xmin else float("inf")


def _upper(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal; evaluated once per distinct value."""
    return 0.5 * np.array([math.erfc(v) for v in z / math.sqrt(2.0)])


def _lognormal_log(x: np.ndarray, xmin: float, mu: float, sigma: float) -> np.ndarray:
    """Log probability of an integer's unit cell under a lognormal tail."""
    z0, z1 = (np.log(x - 0.5) - mu) / sigma, (np.log(x + 0.5) - mu) / sigma
    # The difference of the smaller tails keeps its digits on either side of the mode.
    cell = np.where(z0 > 0, _upper(z0) - _upper(z1), _upper(-z1) - _upper(-z0))
    whole = _upper(np.array([(math.log(xmin - 0.5) - mu) / sigma]))[0]
    return np.log(np.maximum(cell, 1e-300)) - math.log(max(whole, 1e-300))


def fit_lognormal(tail: DataFrame, xmin: float, rounds: int = 12) -> tuple[float, float]:
    """(mu, sigma) of the discretised lognormal tail by a shrinking grid search.

    Each round scores 49 settings with one pass over the distinct values.
    """
    row = tail.agg(F.sum(F.col("n") * F.log("x")).alias("s"), F.sum("n").alias("n"),
                   F.sum(F.col("n") * F.log("x") * F.log("x")).alias("q")).first()
    mu = row["s"] / row["n"]
    sigma = math.sqrt(max(row["q"] / row["n"] - mu * mu, 1e-6))
    span_mu, ratio = 4.0 * sigma, 4.0
    for _ in range(rounds):
        grid = [(mu + span_mu * i / 3, sigma * ratio ** (j / 3)) for i in range(-3, 4) for j in range(-3, 4)]
        totals = _lognormal_totals(tail, xmin, grid)
        best = max(range(len(grid)), key=lambda i: totals[i])
        centre = best == len(grid) // 2
        mu, sigma = grid[best]
        # Move on while the peak lies at an edge, close in once it is inside.
        if centre or not _at_edge(best):
            span_mu, ratio = span_mu / 3, ratio ** (1 / 3)
    return mu, sigma


def _at_edge(index: int) -> bool:
    i, j = divmod(index, 7)
    return i in (0, 6) or j in (0, 6)


def _lognormal_totals(tail: DataFrame, xmin: float, grid) -> list[float]:
    def part(batches):
        total = np.zeros(len(grid))
        for b in batches:
            x, n = b["x"].to_numpy(dtype=float), b["n"].to_numpy(dtype=float)
            for i, (mu, sigma) in enumerate(grid):
                total[i] += float((n * _lognormal_log(x, xmin, mu, sigma)).sum())
        yield pd.DataFrame({"i": np.arange(len(grid)), "total": total})

    sums = tail.select("x", "n").mapInPandas(part, "i int, total double").groupBy("i").agg(F.sum("total").alias("t"))
    found = {r["i"]: r["t"] for r in sums.collect()}
    return [found.get(i, float("-inf")) for i in range(len(grid))]


def compare_tails(df: DataFrame, fit: PowerLawFit, alternative: str) -> dict:
    """Likelihood ratio of the power law against ``exponential`` or ``lognormal`` (Vuong's test).

    Positive ratios favour the power law; ``p`` is the chance of so large a ratio
    when neither is better.
    """
    tail = _tail(df, fit)
    if alternative == "exponential":
        rate = fit_exponential(tail, fit.xmin)
        params = {"rate": rate}
        other = F.lit(math.log(-math.expm1(-rate))) - F.lit(rate) * (F.col("x") - F.lit(fit.xmin))
        logs = tail.select("n", (_power_law_log(fit) - other).alias("d"))
    elif alternative == "lognormal":
        mu, sigma = fit_lognormal(tail, fit.xmin)
        params = {"mu": mu, "sigma": sigma}

        @F.pandas_udf("double")
        def lognormal(x: pd.Series) -> pd.Series:
            return pd.Series(_lognormal_log(x.to_numpy(dtype=float), fit.xmin, mu, sigma))

        logs = tail.select("n", (_power_law_log(fit) - lognormal("x")).alias("d"))
    else:
        raise ValueError(alternative)
    s = logs.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("d")).alias("r"),
                 F.sum(F.col("n") * F.col("d") * F.col("d")).alias("q")).first()
    n, ratio = float(s["n"]), s["r"]
    variance = max(s["q"] / n - (ratio / n) ** 2, 0.0)
    p = math.erfc(abs(ratio) / math.sqrt(2.0 * n * variance)) if variance > 0 else 1.0
    return {"alternative": alternative, "ratio": ratio, "p": p, "rows": int(n), **params}
