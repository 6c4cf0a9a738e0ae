"""Noise, masks and mixing, drawn from row keys."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.hashing import mix_uniform, row_hash, row_words
from netweave.plans.mapping import column


def gaussian(words: Column, stream: str) -> Column:
    """A standard normal draw (Box-Muller) of the row behind ``words``."""
    radius = F.sqrt(F.lit(-2.0) * F.log(mix_uniform(words, stream + ":r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * mix_uniform(words, stream + ":a"))


def _replace(df: DataFrame, new: Mapping[str, Column], words: Column, drop: str = "_w") -> DataFrame:
    """Swap in new values, computing the row's words once."""
    with_words = df.withColumn(drop, words)
    return with_words.select(*[new[c].alias(c) if c in new else column(c) for c in df.columns])


def add_noise(df: DataFrame, features: Sequence[str], key: str, noise: float = 0.05, seed: int = 42) -> DataFrame:
    """Add normal noise of the given deviation to every feature."""
    new = {f: column(f) + F.lit(noise) * gaussian(F.col("_w"), f"noise:{f}") for f in features}
    return _replace(df, new, row_words(key, seed=seed))


def mask(df: DataFrame, features: Sequence[str], key: str, prob: float | Column, mode: str = "element",
         importances: Mapping[str, float] | None = None, value: float = 0.0, seed: int = 42,
         batch: str | None = None) -> DataFrame:
    """Set random cells to ``value``.

    ``element`` decides per cell; ``feature`` decides per column for all rows that
    share ``batch`` (all rows when it is not given).  With ``importances`` a
    feature's probability shrinks to ``prob * (1 - importance)``.
    """
    if mode not in ("element", "feature"):
        raise ValueError(mode)
    prob = prob if isinstance(prob, Column) else F.lit(float(prob))
    if mode == "element":
        words = row_words(key, seed=seed)
    else:
        words = row_words(F.col(batch) if batch else F.lit("all"), seed=seed)
    new = {}
    for f in features:
        p = prob * F.lit(1.0 - float(importances[f])) if importances and f in importances else prob
        new[f] = F.when(mix_uniform(F.col("_w"), f"mask:{f}") < p, F.lit(value)).otherwise(column(f))
    return _replace(df, new, words)


def augment(df: DataFrame, features: Sequence[str], key: str, noise: float = 0.05, mask_prob: float = 0.1,
            seed: int = 42, out: str = "copy") -> DataFrame:
    """The table and a noisy, partly masked copy of it.

    The copy keeps its row's key, so key-based folds hold twins together; ``out``
    tells the two apart.
    """
    twin = df
    if noise:
        twin = add_noise(twin, features, key, noise, seed)
    if mask_prob:
        twin = mask(twin, features, key, mask_prob, seed=seed)
    return df.withColumn(out, F.lit(0)).unionByName(twin.withColumn(out, F.lit(1)))


def mask_probability(epoch: Column, variant: str = "a") -> Column:
    """The three-stage masking schedule over zero-based rounds.

    Fixed values: 5 % for ten rounds, a ramp until round 30, then the ceiling;
    variant ``a`` climbs 0.5 % a round to 15 %, ``b`` 0.75 % to 20 %.
    """
    step, start, ceiling = {"a": (0.005, 9, 0.15), "b": (0.0075, 10, 0.20)}[variant]
    ramp = F.lit(0.05) + (epoch - F.lit(start)) * F.lit(step)
    return F.when(epoch < 10, F.lit(0.05)).when(epoch < 30, ramp).otherwise(F.lit(ceiling))


_TRIES = 16


def beta_draw(words: Column, alpha: float, stream: str) -> Column:
    """A symmetric Beta(alpha, alpha) draw for alpha below 1, by Jöhnk's rejection method.

    For alpha = 0.2 about 95 % of tries are accepted, so sixteen leave nothing to
    speak of; the last try stands in when all are rejected.  Later tries are only
    computed for rows that rejected the earlier ones.
    """
    shape = F.lit(1.0 / alpha)
    shares, last = [], None
    for i in range(_TRIES):
        x = F.pow(mix_uniform(words, f"{stream}:x{i}"), shape)
        y = F.pow(mix_uniform(words, f"{stream}:y{i}"), shape)
        last = F.try_divide(x, x + y)
        shares.append(F.when((x + y <= 1.0) & (x + y > 0.0), last))
    return F.coalesce(*shares, last)


def mixup(df: DataFrame, features: Sequence[str], label: str, key: str, alpha: float = 0.2, seed: int = 42,
          batches: int | None = None, batch_rows: int = 4096) -> DataFrame:
    """Mix every row with a partner from its batch: ``key, draw, label, weight, features``.

    Rows are dealt into batches by key hash; within a batch each row's partner is
    the next one in hash order.  One mixing share per batch, Beta distributed.  Each
    mixed row appears twice, with either label and the share as its weight, which
    is the mixed loss spelled out as weighted rows.
    """
    if batches is None:
        batches = max(1, -(-df.count() // batch_rows))
    h = row_hash(key, seed=seed)
    base = df.select(key, label, *[column(f).cast("double").alias(f) for f in features]).withColumns(
        {"_h": h, "_b": F.pmod(h, F.lit(batches))})
    w = Window.partitionBy("_b").orderBy("_h", key)
    whole = Window.partitionBy("_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct(F.col(label).alias("y"), *[column(f).alias(f"x{i}") for i, f in enumerate(features)])
    partner = F.coalesce(F.lead(row).over(w), F.first(row).over(whole))
    paired = base.withColumn("_p", partner).withColumn("_l", beta_draw(row_words("_b", seed=seed), alpha, "mix"))
    share = F.col("_l")
    mixed = paired.select(
        key, label, "_p", "_l",
        *[(share * column(f) + (F.lit(1.0) - share) * F.col(f"_p.x{i}")).alias(f) for i, f in enumerate(features)],
    )
    sides = F.array(
        F.struct(F.lit(0).alias("draw"), F.col(label).alias("y"), share.alias("weight")),
        F.struct(F.lit(1).alias("draw"), F.col("_p.y").alias("y"), (F.lit(1.0) - share).alias("weight")),
    )
    return mixed.withColumn("_s", F.explode(sides)).select(
        key, F.col("_s.draw").alias("draw"), F.col("_s.y").alias(label), F.col("_s.weight").alias("weight"),
        *[column(f) for f in features])
