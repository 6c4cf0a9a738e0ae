"""Joins split at heavy hitters: only the keys that hold too many rows are dealt over several tasks.

One pass with a mergeable frequency sketch finds the keys with more than a share of the rows.
Their rows on the large side get a part number from a hash of their other columns, their rows
on the other side are repeated for every part, and the join takes the part into its key; all
other keys join as they are.  Part numbers follow the rows' contents, so a task that runs again
deals them the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from netweave.plans.mapping import column

#: Keys with at least this share of the rows are split.
SHARE = 1 / 128
#: Keys that the sketch follows; a count is off by less than 4 rows in this many.
TRACKED = 4096
#: Parts of a heavy key for each shuffle partition.
PARTS_EACH = 16


def heavy_hitters(df: DataFrame, digest: Column, share: float = SHARE, tracked: int = TRACKED) -> list[int]:
    """64-bit digests that at least ``share`` of the rows have, and perhaps some with a little less.

    The sketch of a task holds at most ``tracked`` digests, whatever the rows; sketches are merged.
    """
    most = int(2 / share)
    row = df.select(digest.alias("_d")).agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(_d, {most}, {tracked})").alias("top")).first()
    least = (share - 4 / tracked) * row["n"]
    return sorted(t["item"] for t in row["top"] or [] if t["item"] is not None and t["count"] >= least)


def digest_of(on: Sequence[str]) -> Column:
    return F.xxhash64(*[column(c) for c in on])


def split_join(large: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", share: float = SHARE,
               parts: int | None = None, hot: Sequence[int] | None = None) -> DataFrame:
    """``large.join(small, on, how)`` for an inner, left, left_semi or left_anti join, heavy keys of ``large`` split.

    ``small`` should hold few rows for a key, since those of heavy keys are repeated ``parts``
    times (``PARTS_EACH`` for every shuffle partition by default).  Null keys match nothing, as
    in any join; in an outer join they are split like other heavy keys.  Rows of a heavy key
    that are equal in every column stay together.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    hot = heavy_hitters(large, digest_of(on), share) if hot is None else list(hot)
    if not hot:
        return large.join(small, list(on), how)
    if parts is None:
        parts = PARTS_EACH * int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in large.columns if c not in on and not isinstance(large.schema[c].dataType, (MapType, VariantType))]
    deal = F.pmod(F.xxhash64(F.lit(1), *[column(c) for c in others]), F.lit(parts)).cast("int")
    taken = {*large.columns, *small.columns}
    part = next(n for n in (f"_part{i}" for i in range(len(taken) + 1)) if n not in taken)
    dealt = large.withColumn(part, F.when(digest_of(on).isin(hot), deal).otherwise(0))
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    repeated = small.withColumn(part, F.explode(F.when(digest_of(on).isin(hot), every).otherwise(F.array(F.lit(0)))))
    return dealt.join(repeated, [*on, part], how).drop(part)
