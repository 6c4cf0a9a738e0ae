"""SimHash fingerprints of whole texts, and their exact comparison in tiles.

Different fingerprints are dealt to cells by the bit counts of their four 16-bit words.  If
two fingerprints differ in at most r bits, these counts differ by at most r in total, so all
other pairs of cells are skipped unseen.  Cells of many fingerprints are cut into several
tiles; the remaining tile pairs are rows, and each is compared exactly by exclusive-or and
bit counts.  A pair of tiles answers with one link per fingerprint to the smallest one that
it reaches there, not with all pairs, and connected components join these up.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.base import each_bytes, field, over_texts
from netweave.llm.components import components, local_roots
from netweave.session import materialize

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints in a tile, on average at most.
TILE = 2048
_STRETCH = 1 << 15
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text, signed as in a 64-bit column.

    Words are runs of anything but ASCII white space, letters A-Z lowered.  Every run of
    ``shingle`` words, joined by spaces, is hashed by XXH64; fewer words make one shingle, and
    no words give zero.  A bit is set if more than half of the hashes set it.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    stops = ends[-n:]
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, n, _STRETCH):
        pairs = zip(starts[i:min(i + _STRETCH, n)].tolist(), stops[i:i + _STRETCH].tolist())
        raw = b"".join([digest(line[a:b], seed) for a, b in pairs])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n).view(">i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """(``key``, ``fp``) of every row; null and empty texts have fingerprint zero."""

    def run(texts: pa.Array):
        return [pa.array([fingerprint(t, shingle, seed) for t in each_bytes(texts)], pa.int64())]

    return over_texts(docs, text, [key], "fp long", run)


def _bits(k: int):
    return F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)).cast("int")


def tiles(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """Different fingerprints (``fp``) as rows (``cell``: four bit counts, ``sub``, ``fps``)."""
    celled = prints.withColumn("cell", F.array(*[_bits(k) for k in range(4)]))
    # At most 17**4 cells.
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("_subs"))
    dealt = celled.join(F.broadcast(sizes), "cell").withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("_subs")).cast("int"))
    return dealt.groupBy("cell", "sub").agg(F.sort_array(F.collect_list("fp")).alias("fps"))


def _steps(radius: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite moves between cells within the radius."""
    near = [s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius]
    return [s for s in near if s >= (0, 0, 0, 0)]


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            ours, theirs, same = batch.columns
            heads, roots = [], []
            for i in range(batch.num_rows):
                a = ours[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = a if same[i].as_py() else theirs[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
                if b is a:
                    x, y = x[x < y], y[x < y]
                    both = a
                else:
                    y = y + len(a)
                    both = np.concatenate([a, b])
                if len(x):
                    root = local_roots(len(both), x, y)
                    moved = np.flatnonzero(root != np.arange(len(both)))
                    heads.append(both[moved])
                    roots.append(both[root[moved]])
            if heads:
                arrays = [pa.array(np.concatenate(p).view(np.int64)) for p in (heads, roots)]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    return run


def close_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(``a``, ``b``): links that connect all different fingerprints (``fp``) within ``radius`` bits.

    The links of one pair of tiles connect what is connected there; other pairs follow from them.
    """
    cut = materialize(tiles(prints, tile), "tiles")
    moves = F.array(*[F.array(*[F.lit(d) for d in s]) for s in _steps(radius)])
    ours = cut.select(
        F.explode(F.transform(moves, lambda m: F.zip_with("cell", m, lambda c, d: c + d))).alias("to"),
        F.col("cell").alias("home"), F.col("sub").alias("home_sub"), F.col("fps").alias("ours"))
    theirs = cut.select(F.col("cell").alias("to"), "sub", F.col("fps").alias("theirs"))
    pairs = ours.join(theirs, "to").where((F.col("to") != F.col("home")) | (F.col("sub") >= F.col("home_sub")))
    same = (F.col("to") == F.col("home")) & (F.col("sub") == F.col("home_sub"))
    return pairs.select("ours", "theirs", same.alias("same")).mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """(``key``, ``fingerprint`` of 16 hex digits, ``component_id``) of every row.

    Texts are linked if their fingerprints differ in at most ``radius`` bits, and
    ``component_id`` is the least key of those a text reaches, itself included.  A null key
    never is the least one unless there are only such.
    """
    rows = materialize(fingerprints(docs, key, text, shingle, seed).withColumnRenamed(key, "_key"), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("_key").alias("least")), "different")
    linked = components(close_links(prints.select("fp"), radius, tile))
    # Only fingerprints with a close neighbour are in ``linked``.
    rooted = prints.join(linked, prints["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    leasts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = materialize(rooted.join(leasts, "root").select("fp", "component_id"), "classes")
    full = rows.join(known, "fp")
    return full.select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
