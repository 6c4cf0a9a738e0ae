"""Samples, splits and folds drawn by key hash.

The same key always lands in the same place, whatever the partitioning.  Exact
sample sizes need no global sort: the hash value that cuts off the wanted number
of rows is found by counting hash prefixes, and the sample is then a filter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.hashing import HASH_BITS, row_hash, unit_hash

_STEP_BITS = 12
_BOUNDARY = 20_000


def sample_fraction(df: DataFrame, fraction: float, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Rows whose key hashes below ``fraction``."""
    return df.where(unit_hash(*_keys(key), seed=seed) < F.lit(float(fraction)))


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


@dataclass(frozen=True)
class Cut:
    """The last hash value and key that still belong to a group's sample."""

    group: object
    hash: int
    keys: tuple


def hash_cuts(df: DataFrame, by: str | None, wanted: Mapping, key: str | Sequence[str], seed: int = 42) -> list[Cut]:
    """For each group the (hash, key) such that exactly ``wanted[group]`` rows come before or at it
    (or, where the last key has several rows, the first key that reaches as many).

    Groups that want no rows, or at least as many as they have, get no cut.  Each
    round counts the next bits of the hash among the rows that share the prefix
    found so far; it stops when few enough rows share it to be ranked outright.
    """
    keys = _keys(key)
    h = row_hash(*keys, seed=seed)
    group = F.col(by) if by else F.lit("all")
    base = df.select(group.alias("_g"), h.alias("_h"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    left = {g: int(n) for g, n in wanted.items() if n > 0}
    prefix: dict = {g: 0 for g in left}
    shift = HASH_BITS
    ready: dict = {}
    while left and len(ready) < len(left):
        shift -= _STEP_BITS
        open_groups = {g: p for g, p in prefix.items() if g not in ready}
        rows = _in_prefix(base, open_groups, shift + _STEP_BITS)
        counts = (
            rows.groupBy("_g", F.shiftright("_h", shift).alias("_p")).agg(F.count("*").alias("n"))
            .orderBy("_g", "_p").collect()
        )
        seen: dict = {}
        for r in counts:
            g = r["_g"]
            if seen.get(g) == "found":
                continue
            if left[g] <= r["n"]:
                seen[g], prefix[g] = "found", r["_p"]
                if r["n"] <= _BOUNDARY or shift == 0:
                    ready[g] = shift
            else:
                left[g] -= r["n"]
        for g in open_groups:
            if seen.get(g) != "found":
                # The whole group fits: nothing to cut.
                left.pop(g), prefix.pop(g), ready.pop(g, None)
    return _rank_boundary(base, prefix, ready, left, len(keys))


def _in_prefix(base: DataFrame, prefix: Mapping, bits: int) -> DataFrame:
    if bits >= HASH_BITS:
        return base.where(F.col("_g").isin(*prefix))
    test = F.lit(False)
    for g, p in prefix.items():
        test = test | ((F.col("_g") == F.lit(g)) & (F.shiftright("_h", bits) == F.lit(p)))
    return base.where(test)


def _rank_boundary(base: DataFrame, prefix, ready, left, n_keys: int) -> list[Cut]:
    if not left:
        return []
    test = F.lit(False)
    for g, p in prefix.items():
        test = test | ((F.col("_g") == F.lit(g)) & (F.shiftright("_h", ready[g]) == F.lit(p)))
    key_cols = [f"_k{i}" for i in range(n_keys)]
    # Rows that share a key come or go together, so keys are ranked, however many rows each has.
    counts = base.where(test).groupBy("_g", "_h", *key_cols).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_g").orderBy("_h", *key_cols).rowsBetween(Window.unboundedPreceding, 0)
    at = F.lit(False)
    for g, n in left.items():
        reached = (F.col("_r") >= F.lit(n)) & (F.col("_r") - F.col("_n") < F.lit(n))
        at = at | ((F.col("_g") == F.lit(g)) & reached)
    rows = counts.withColumn("_r", F.sum("_n").over(w)).where(at).collect()
    return [Cut(r["_g"], r["_h"], tuple(r[k] for k in key_cols)) for r in rows]


def within_cut(cuts: Sequence[Cut], by: str | None, wanted: Mapping, counts: Mapping, key: str | Sequence[str],
               seed: int = 42) -> Column:
    """Whether a row belongs to its group's exact sample."""
    keys = _keys(key)
    h = row_hash(*keys, seed=seed)
    group = F.col(by) if by else F.lit("all")
    cut_of = {c.group: c for c in cuts}
    test = F.lit(False)
    for g, n in wanted.items():
        mine = group == F.lit(g)
        if n >= counts.get(g, 0):
            test = test | mine
        elif n > 0:
            c = cut_of[g]
            tie = F.lit(True)
            for k, v in reversed(list(zip(keys, c.keys))):
                tie = (F.col(k) < F.lit(v)) | ((F.col(k) == F.lit(v)) & tie)
            test = test | (mine & ((h < F.lit(c.hash)) | ((h == F.lit(c.hash)) & tie)))
    return F.coalesce(test, F.lit(False))


def group_sizes(df: DataFrame, by: str) -> dict:
    """Rows per class; meant for label columns, whose distinct values are few."""
    return {r[0]: r[1] for r in df.groupBy(by).agg(F.count("*").alias("n")).collect()}


def sample_quota(df: DataFrame, label: str, quotas: Mapping[str, int], key: str | Sequence[str], seed: int = 42,
                 ignore_case: bool = False) -> DataFrame:
    """Exactly ``quotas[class]`` rows of each listed class, or all rows where a class is short."""
    if ignore_case:
        return sample_quota(df.withColumn("_class", F.lower(label)), "_class", quotas, key, seed).drop("_class")
    df = df.where(F.col(label).isin(*quotas))
    sizes = group_sizes(df, label)
    short = {g: n for g, n in quotas.items() if n < sizes.get(g, 0)}
    cuts = hash_cuts(df, label, short, key, seed) if short else []
    return df.where(within_cut(cuts, label, quotas, sizes, key, seed))


def split_random(df: DataFrame, fractions: Sequence[float], key: str | Sequence[str], seed: int = 42,
                 names: Sequence[str] = ("train", "test", "validation"), out: str = "split") -> DataFrame:
    """Add the part each row falls into; part sizes hold in expectation."""
    u = unit_hash(*_keys(key), seed=seed)
    edge, part = 0.0, None
    for name, fraction in list(zip(names, fractions))[:-1]:
        edge = round(edge + fraction, 12)
        part = F.when(u < F.lit(edge), F.lit(name)) if part is None else part.when(u < F.lit(edge), F.lit(name))
    last = F.lit(names[len(fractions) - 1])
    return df.withColumn(out, last if part is None else part.otherwise(last))


def split_stratified(df: DataFrame, label: str, test_fraction: float, key: str | Sequence[str], seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Train/test parts with the exact test share (rounded) in every class."""
    sizes = group_sizes(df, label)
    wanted = {g: int(n * test_fraction + 0.5) for g, n in sizes.items() if g is not None}
    cuts = hash_cuts(df, label, {g: n for g, n in wanted.items() if 0 < n < sizes[g]}, key, seed)
    test = within_cut(cuts, label, wanted, sizes, key, seed)
    return df.withColumn(out, F.when(test, F.lit("test")).otherwise(F.lit("train")))


def with_fold(df: DataFrame, k: int, key: str | Sequence[str], seed: int = 42, out: str = "fold") -> DataFrame:
    """Shuffled k-fold number; copies of a row that share its key stay together."""
    return df.withColumn(out, F.pmod(row_hash(*_keys(key), seed=seed), F.lit(k)).cast("int"))
