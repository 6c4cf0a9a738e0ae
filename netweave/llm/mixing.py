"""Mixing sources to target sizes by pivotal dependent rounding over a reduction tree.

A source's target over its size is the expected number of copies of each of its documents.
The whole part is certain; the rest is a probability that must become zero or one extra
copy.  Two documents with open probabilities trade words: mass moves from one to the other
until one of them has none or all of its words, which way being drawn so that every
document keeps its expectation.  No words are lost, so a source's total stays what it was.
Leaves settle bounded groups of a source's documents, sizes of one power of two among
themselves, and pass the few left open up a tree of nodes, with the smallest ones, which they
hold back.  At a source's root the largest open one is settled against all smaller ones at
once, and so on until a single small one is left, which is drawn by itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.llm.base import field, over_texts, text_buffers
from netweave.operators.ordering import with_row_ids
from netweave.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
#: Documents in a leaf and children of a node, on average at most.
LEAF = 2_000
FAN = 32
#: Parts of a unit of many equal rows, numbered side by side.
_PARTS = 64
#: Smallest open documents that a node, and a root, does not settle by pairs.
HELD, HELD_ROOT = 64, 256

_SPACE = np.zeros(256, np.bool_)
_SPACE[[32, *range(9, 14)]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """Runs of anything but ASCII white space in each text."""
    raw, at = text_buffers(texts)
    at = at.astype(np.int64) - int(at[0])
    word = ~_SPACE[raw[int(text_buffers(texts)[1][0]):][:at[-1]]]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = at[:-1][at[:-1] < at[-1]]
    begins[first] = word[first]
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[at[1:]] - total[at[:-1]]


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   limit: float = LIMIT) -> DataFrame:
    """Add ``target`` to the sources (``source``, ``source_size``), one row each.

    Sources in code-point order, null last, take the weights in turn and divide ``share`` of the
    total size by them; a target stops at ``limit`` times its source's size, and the excess is
    divided among the others until none is above.
    """
    ranked = with_row_ids(sizes, [F.asc_nulls_last("source")], name="_rank")
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = materialize(ranked.withColumn(
        "_weight", F.element_at(table, (F.col("_rank") % len(weights) + 1).cast("int"))), "sources")
    cap = F.lit(float(limit)) * F.col("source_size")
    level, settled = 0.0, -1
    while True:
        # A source is at its limit if its part at the present level would be above.
        full = F.col("_weight") * F.lit(level) > cap
        row = weighed.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, cap)).alias("stopped"),
            F.sum(F.when(~full, F.col("_weight"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if row["n"] == settled or not row["open"]:
            level = level if row["open"] else float("inf")
            break
        settled = row["n"]
        level = max(0.0, share * (row["all"] or 0) - (row["stopped"] or 0.0)) / row["open"]
    target = F.least(cap, F.col("_weight") * F.lit(level)) if np.isfinite(level) else cap
    return weighed.select("source", "source_size", target.cast("double").alias("target"))


def trade(size: np.ndarray, mass: np.ndarray, units, rng: np.random.Generator) -> None:
    """Settle ``units`` in turn against the one still open, until at most one is."""
    open_one = -1
    for i in units:
        if not _open(size[i], mass[i]):
            continue
        if open_one < 0:
            open_one = i
            continue
        a, b = open_one, i
        gain, loss = min(size[a] - mass[a], mass[b]), min(mass[a], size[b] - mass[b])
        if rng.random() * (gain + loss) < loss:
            mass[a], mass[b] = mass[a] + gain, mass[b] - gain
        else:
            mass[a], mass[b] = mass[a] - loss, mass[b] + loss
        left = [k for k in (a, b) if _open(size[k], mass[k])]
        open_one = left[0] if left else -1


def _open(size: float, mass: float) -> bool:
    return 1e-9 * size < mass < (1 - 1e-9) * size


def settle(size: np.ndarray, mass: np.ndarray, rng: np.random.Generator) -> None:
    """Settle all units: the largest open one against all smaller ones at once, the last by a draw."""
    for _ in range(20 * len(size) + 20):
        units = [i for i in range(len(size)) if _open(size[i], mass[i])]
        if len(units) < 2:
            break
        units.sort(key=lambda i: (-size[i], i))
        big, rest = units[0], np.array(units[1:])
        part = np.minimum(mass[rest], size[rest] - mass[rest])
        whole = part.sum()
        gain, loss = min(size[big] - mass[big], whole), min(mass[big], whole)
        if rng.random() * (gain + loss) < loss:
            mass[big], mass[rest] = mass[big] + gain, mass[rest] - part * (gain / whole)
        else:
            mass[big], mass[rest] = mass[big] - loss, mass[rest] + part * (loss / whole)
    trade(size, mass, range(len(size)), rng)
    for i in range(len(size)):
        if _open(size[i], mass[i]):
            mass[i] = size[i] if rng.random() * size[i] < mass[i] else 0.0


def _node(seed: int, level: int, root: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        source, node = key[0], int(key[1])
        # Rows in an order of their own, so that a rerun draws the same.
        names = [str(k) for k in rows["key"]]
        marks = [crc32(f"{seed}|{n}".encode()) for n in names]
        order = sorted(range(len(rows)), key=lambda i: (marks[i], names[i], rows["size"].iat[i]))
        rows = rows.iloc[order].reset_index(drop=True)
        size = rows["size"].to_numpy(np.float64)
        mass = rows["mass"].to_numpy(np.float64).copy()
        missing = source is None or source != source
        rng = np.random.default_rng([seed, level, node, crc32(("" if missing else "=" + str(source)).encode())])
        tier = np.frexp(size)[1]
        free = np.array([_open(s, m) for s, m in zip(size, mass)], np.bool_)
        small = np.flatnonzero(free)[np.argsort(size[free], kind="stable")[:HELD_ROOT if root else HELD]]
        free[small] = False
        for t in np.unique(tier)[::-1]:
            trade(size, mass, np.flatnonzero(free & (tier == t)), rng)
        if root:
            settle(size, mass, rng)
        rows["mass"] = mass
        rows["settled"] = [not _open(s, m) for s, m in zip(size, mass)]
        return rows

    return run


def _mixed_units(docs: DataFrame, key: str, source: str, text: str, weights: Sequence[float], share: float, limit: float,
                 seed: int, leaf: int, fan: int) -> DataFrame:
    """Rows equal in key, source and size as one unit: ``source``, ``key``, ``size``, ``times`` (rows),
    ``source_size``, ``target`` and ``_all`` (copies that its rows share)."""
    kinds = dict(docs.dtypes)
    rows = docs.select(field(docs, key).alias("key"), field(docs, source).alias("source"), field(docs, text).alias("_body"))
    sized = materialize(over_texts(rows, "_body", ["key", "source"], "size long",
                                   lambda texts: [pa.array(word_counts(texts), pa.int64())])
                        .groupBy("source", "key", "size").agg(F.count("*").alias("times")), "sizes")
    sums = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"),
                                       F.count("*").alias("units"))
    sums = materialize(sums, "source-sizes")
    targets = source_targets(sums.select("source", "source_size"), weights, share, limit)
    known = sums.join(targets.drop("source_size"), sums["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    shared = sized.join(known.withColumnRenamed("source", "_s"), sized["source"].eqNullSafe(F.col("_s"))).drop("_s")
    expected = F.when(F.col("source_size") > 0, F.col("times") * F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(expected + 1e-9)
    node = F.pmod(F.xxhash64(F.lit(seed), "key", "size"), F.ceil(F.col("units") / leaf)).cast("long")
    units = shared.select(
        "source", "key", "size", "times", "source_size", "target", whole.alias("base"),
        (F.greatest(expected - whole, F.lit(0.0)) * F.col("size")).alias("mass"), node.alias("node"),
        (F.col("size") == 0).alias("settled"))
    nodes = max(1, -(-(sums.agg(F.max("units").alias("n")).first()["n"] or 1) // leaf))
    schema = (f"source {kinds[source]}, key {kinds[key]}, size long, times long, source_size long, target double,"
              " base long, mass double, node long, settled boolean")
    done, level = units.where("settled"), 0
    waiting = units.where("not settled")
    while True:
        root = nodes == 1
        now = materialize(waiting.groupBy("source", "node").applyInPandas(_node(seed, level, root), schema), "mixed")
        done = done.unionByName(now if root else now.where("settled"))
        if root:
            break
        waiting = now.where("not settled").withColumn("node", F.floor(F.col("node") / fan).cast("long"))
        nodes, level = -(-nodes // fan), level + 1
    extra = F.when((F.col("size") > 0) & (F.col("mass") > 0.5 * F.col("size")), 1).otherwise(0)
    return done.withColumn("_all", F.col("base") + extra)


def _dealt(rank: str) -> Column:
    """The copies of a unit's row of this rank."""
    return F.floor(F.col("_all") / F.col("times")) + (F.col(rank) <= F.col("_all") % F.col("times")).cast("long")


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
                weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 42,
                leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(``key``, size, source, source_size, target, copies, taken) of every row.

    ``size`` is the number of words (null text: 0), ``copies`` how often the mix takes the row, at
    most ``limit`` rounded up, and ``taken`` the words that makes.  Rows equal in key, source and
    size are one unit that shares its copies evenly among them.  Draws depend on the keys and
    the seed alone.  Empty texts take part with no words.
    """
    total = _mixed_units(docs, key, source, text, weights, share, limit, seed, leaf, fan)
    each = total.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    copies = _dealt("_row")
    return each.select(F.col("key").alias(key), "size", F.col("source").alias("_source"), "source_size", "target",
                       copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", copy: str = "copy",
                    weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = 42,
                    leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """The rows of the mix: ``docs`` with all columns, each as often as it is taken, numbered by ``copy`` from 1.

    Draws depend on keys, texts and the seed alone, so that the same documents in other files or
    tasks make the same mix.  Rows equal in key, source and text are one unit; of its copies, rows
    are dealt theirs in the order of their other columns.  Null and empty texts have no words and
    are not taken.  Where the documents have a column ``copy``, the number's name gets underscores
    until it is free.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    k, s, t = (names[docs.columns.index(c)] for c in (key, source, text))
    others = [n for n in names if n not in (k, s, t)]
    while copy in docs.columns:
        copy += "_"
    frozen = materialize(docs.toDF(*names).withColumn("_id", F.monotonically_increasing_id()), "documents")
    unit = F.sha2(F.concat_ws("|", F.col(k).isNull().cast("string"), F.coalesce(F.col(k).cast("string"), F.lit("")),
                              F.sha2(F.coalesce(F.col(t), F.lit("")), 256)), 256)
    rest = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0).cast("long")
    keyed = frozen.select("_id", unit.alias("_unit"), F.col(s).alias("_source"), F.col(t).alias("_text"), rest.alias("_rest"))
    units = _mixed_units(keyed, "_unit", "_source", "_text", weights, share, limit, seed, leaf, fan).where("_all > 0").select(
        F.col("key").alias("_unit"), F.col("source").alias("_from"), "times", "_all")
    rows = keyed.select("_id", "_unit", "_source", "_rest")
    found = materialize(rows.join(units, (rows["_unit"] == units["_unit"]) & rows["_source"].eqNullSafe(units["_from"])).select(
        "_id", rows["_unit"], "_source", "_rest", "times", "_all"), "taken")
    # Ranks within a unit of many rows are added up over parts of it.
    part = ["_unit", "_source", "_rest", "_part"]
    many = found.where("times > 1").withColumn("_part", F.pmod("_id", F.lit(_PARTS)))
    sizes = many.groupBy(*part).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_unit", "_source").orderBy("_rest", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"{c}_") for c in part], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = many.withColumn("_place", F.row_number().over(Window.partitionBy(*part).orderBy("_id")))
    same = [ranked[c].eqNullSafe(offsets[f"{c}_"]) for c in part]
    placed = ranked.join(offsets, same[0] & same[1] & same[2] & same[3]).withColumn("_rank", F.col("_before") + F.col("_place"))
    copies = found.where("times = 1").select("_id", F.col("_all").alias("_copies")).unionByName(
        placed.select("_id", _dealt("_rank").alias("_copies"))).where("_copies > 0")
    joined = frozen.join(copies, "_id").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return joined.select(*names, "_copy").toDF(*docs.columns, copy)
