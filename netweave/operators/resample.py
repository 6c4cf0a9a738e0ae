"""Synthetic minority over-sampling.

Every draw follows from the seed row's key, so a rerun, a lost executor or
another engine produces the same rows.  Seeds are drawn evenly: each minority
row is used floor(new/size) times and the remainder goes to the rows with the
smallest key hashes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.functions.hashing import mix_uniform, row_words
from netweave.operators.neighbors import BLOCK_ROWS, nearest
from netweave.operators.sampling import group_sizes, hash_cuts, within_cut
from netweave.plans.mapping import column

_SMALL = 20_000  # rows of a class that may be broadcast to its draws
_STEP = 10_000


def smote(df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, categorical: Sequence[str] = (),
          carry: Sequence[str] = (), when_below: float | None = None, seed: int = 42,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Raise every class to the size of the largest one.

    Numeric features move a random part of the way to one of the ``k`` nearest rows
    of the same class; ``categorical`` ones take the most frequent value among the
    ``k`` (the smallest on a tie); ``carry`` columns are copied from the seed row.

    Output: ``key`` (of the seed for synthetic rows), ``draw`` (null for original
    rows), label, features, categories, carried columns.  With ``when_below`` the
    table passes through unless some class has a smaller share; so does a table
    with one class.
    """
    sizes = {g: n for g, n in group_sizes(df, label).items() if g is not None}
    original = df.select(key, F.lit(None).cast("long").alias("draw"), label,
                         *[column(f).cast("double").alias(f) for f in features],
                         *[column(c) for c in (*categorical, *carry)])
    total = sum(sizes.values())
    if len(sizes) < 2 or (when_below is not None and min(sizes.values()) / total >= when_below):
        return original
    largest = max(sizes.values())
    # Draw numbers can pass two billion when a class is tiny.
    out = original
    for value, size in sorted(sizes.items()):
        if size < largest:
            if size <= k:
                raise ValueError(f"class {value!r} has {size} rows; {k} neighbours need at least {k + 1}")
            rows = original.where(F.col(label) == F.lit(value))
            out = out.unionByName(_synthesize(rows, features, categorical, carry, label, key, k, size, largest - size,
                                              seed, block_rows))
    return out


def _synthesize(rows: DataFrame, features, categorical, carry, label, key, k, size, new, seed, block_rows) -> DataFrame:
    penalty = _category_penalty(rows, features) if categorical else 0.0
    near = nearest(rows, None, features, key, k, categorical, penalty, block_rows)
    base, extra = divmod(new, size)
    cuts = hash_cuts(rows, None, {"all": extra}, key, seed) if extra else []
    more = within_cut(cuts, None, {"all": extra}, {"all": size}, key, seed).cast("int")
    small = size <= _SMALL
    draws = (
        _repeat(rows.drop("draw").withColumn("_m", F.lit(base) + more), key, base)
        .withColumn("_w", row_words(key, "draw", seed=seed))
        .withColumn("_u", mix_uniform(F.col("_w"), "step"))
        .withColumn("rank", (F.pmod(F.col("_w.a"), F.lit(k)) + 1).cast("int"))
    )
    picked = near.select(F.col(key).alias("_seed"), F.col("rank").alias("_rank"), "neighbor")
    chosen = draws.join(_side(picked, small), (F.col(key) == F.col("_seed")) & (F.col("rank") == F.col("_rank")))
    ends = rows.select(F.col(key).alias("_end"), *[column(f).alias(f"_n_{i}") for i, f in enumerate(features)])
    moved = chosen.join(_side(ends, small), F.col("neighbor") == F.col("_end"))
    values = [(column(f) + F.col("_u") * (F.col(f"_n_{i}") - column(f))).alias(f) for i, f in enumerate(features)]
    if not categorical:
        return moved.select(key, "draw", label, *values, *[column(c) for c in carry])
    # The neighbours' values are counted per seed row, not per draw.
    look = rows.select(F.col(key).alias("_end"), *[column(c).alias(f"_c_{i}") for i, c in enumerate(categorical)])
    modes = (
        near.join(look, F.col("neighbor") == F.col("_end")).groupBy(F.col(key).alias("_of"))
        .agg(*[F.mode(f"_c_{i}", True).alias(f"_m_{i}") for i in range(len(categorical))])
    )
    return moved.join(_side(modes, small), F.col(key) == F.col("_of")).select(
        key, "draw", label, *values, *[F.col(f"_m_{i}").alias(c) for i, c in enumerate(categorical)],
        *[column(c) for c in carry])


def _side(table: DataFrame, small: bool) -> DataFrame:
    """A class's own rows next to its draws: broadcast when the counted class is small.

    A small class has many draws per row, which would make a shuffle lopsided.
    """
    return F.broadcast(table) if small else table


def _repeat(rows: DataFrame, key: str, times: int) -> DataFrame:
    """Each row ``_m`` times with a ``draw`` number.

    Long runs are dealt out in steps, so that a handful of rows can become billions
    without one task or one array holding them all.
    """
    last = F.col("_m") - 1
    steps = rows.where(F.col("_m") > 0).withColumn(
        "_o", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / F.lit(_STEP)).cast("long"))))
    if times > _STEP:
        steps = steps.repartition(key, "_o")
    start = F.col("_o") * F.lit(_STEP)
    inner = F.sequence(start, F.least(start + F.lit(_STEP - 1), last.cast("long")))
    return steps.withColumn("draw", F.explode(inner)).drop("_o", "_m")


def _category_penalty(rows: DataFrame, features) -> float:
    """Half the squared median of the features' deviations within the class.

    This is what two differing one-hot positions of half that deviation each add to
    a squared distance.
    """
    row = rows.agg(*[F.stddev_pop(column(f)).alias(f"s{i}") for i, f in enumerate(features)]).first()
    spread = sorted(row)
    mid = len(spread) // 2
    median = spread[mid] if len(spread) % 2 else (spread[mid - 1] + spread[mid]) / 2
    return median * median / 2


def nearest_domain(rows: DataFrame, sources: DataFrame, features: Sequence[str], key: str, source_key: str,
                   domain: str) -> DataFrame:
    """Give each row the domain of its nearest source row."""
    near = nearest(rows, sources, features, key, 1, ref_key=source_key)
    domains = sources.select(F.col(source_key).alias("neighbor"), F.col(domain))
    return near.join(domains, "neighbor").select(key, "neighbor", domain, "distance")
