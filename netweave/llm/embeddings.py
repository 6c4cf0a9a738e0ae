"""Near-duplicate vectors, by products of int8 tiles with proven error bounds.

Vectors of one label and width are dealt to tiles, and tiles to strips of a bounded size.  Pairs
of strips are the cells of a grid: a tile travels once to each cell of its row and column, not
once for each other tile, and a cell compares all its pairs of tiles.  In a task each unit vector u becomes s * q with whole numbers q in -127..127, and e = |u - s * q| is
measured.  For two vectors

    |u.v - s q . t r| = |(u - s q).v + s q.(v - t r)| <= e_u + (1 + e_u) * e_v,

so the product of the int8 tiles (whole numbers, exact in single precision for up to 1,040
components, else in double) decides almost all pairs.  The cosine is recomputed in double
precision only where the bound allows the threshold to be reached.

Equal vectors are compared once and counted.  A pair of tiles answers with one row for each
vector that has a link there: its links, and one vector for all that it reaches there.  Vectors
are ordered by their least keys, so the root of a component already names its least key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from netweave.llm.base import field
from netweave.llm.components import components, local_roots
from netweave.session import materialize

THRESHOLD = 0.93
#: Vectors in a tile, on average at most.
TILE = 1024
#: A strip of tiles holds about so many bytes of components; a task holds two strips.
STRIP_BYTES = 16 << 20
#: Labels of up to so many tiles have strips of one tile, so that small tables spread too.
_SIDE = 16
#: Pairs recomputed at a time.
_RECHECK = 16_384
#: Slack for the rounding of the bound and of the products themselves.
_SLACK = 1e-9
#: A vector in the order of its least key, null keys last.
_NODE = ("none", "least", "id")


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 rows, their scales, and the lengths of what was lost."""
    scale = np.abs(units).max(1) / 127
    whole = np.rint(units / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((units - whole * scale[:, None]) ** 2).sum(1))
    return whole, scale, lost


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def close_pairs(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs with a cosine of at least ``threshold``; each pair once if ``same``."""
    u, v = _units(left), None
    v = u if same else _units(right)
    q, s, e = quantised(u)
    r, t, f = (q, s, e) if same else quantised(v)
    exact = np.float32 if left.shape[1] * 127 * 127 < 1 << 24 else np.float64
    rough = (q.astype(exact) @ r.astype(exact).T).astype(np.float64)
    rough *= s[:, None]
    rough *= t[None, :]
    reach = e[:, None] + (1 + e)[:, None] * f[None, :] + _SLACK
    i, j = np.nonzero(rough + reach >= threshold)
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), np.bool_)
    for k in range(0, len(i), _RECHECK):
        part = slice(k, k + _RECHECK)
        keep[part] = np.einsum("ij,ij->i", u[i[part]], v[j[part]]) >= threshold
    return i[keep], j[keep]


def _compare(threshold: float, none: pa.Table):
    def nodes(rows) -> pa.Array:
        return pa.StructArray.from_arrays([rows.field(c) for c in _NODE], names=list(_NODE))

    def matrix(rows) -> np.ndarray:
        flat = rows.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(rows), -1)

    def pair(a, b, same: bool):
        i, j = close_pairs(matrix(a), matrix(b), threshold, same)
        if not len(i):
            return None
        both = nodes(a) if same else pa.concat_arrays([nodes(a), nodes(b)])
        copies = np.concatenate([x.field("copies").to_numpy() for x in ((a,) if same else (a, b))])
        j = j if same else j + len(a)
        links = np.zeros(len(both), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        held = np.flatnonzero(links)
        roots = local_roots(len(both), i, j)[held]
        return pa.RecordBatch.from_arrays(
            [both.take(pa.array(held)), both.take(pa.array(roots)), pa.array(links[held])], names=["a", "b", "links"])

    def tiles(table: pa.Table) -> list:
        return [row.values for chunk in table.column("rows").chunks for row in chunk]

    def cell(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        # A cell on the diagonal gets its strip once.
        left, right = tiles(ours), tiles(theirs)
        pairs = ((a, b, False) for a in left for b in right) if right else (
            (a, b, n == m) for n, a in enumerate(left) for m, b in enumerate(left[n:], n))
        found = [f for f in (pair(*p) for p in pairs) if f is not None]
        return pa.Table.from_batches(found) if found else none

    return cell


def _identified(rows: DataFrame, kind: str) -> DataFrame:
    """Add ``id``, a digest of label, width and components; null where a vector links with nothing."""

    def run(batches):
        for batch in batches:
            ids = []
            for label, vector in zip(batch.column(1).to_pylist(), batch.column(2)):
                good = label is not None and vector.is_valid and len(vector.values) and not vector.values.null_count
                x = vector.values.to_numpy(zero_copy_only=False) if good else None
                # -0.0 + 0.0 is 0.0: equal vectors get equal digests.
                good = good and np.isfinite(x).all() and bool(x.any())
                ids.append(hashlib.md5(repr((label, len(x))).encode() + (x + 0.0).tobytes()).digest() if good else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())],
                                             names=["_key", "_label", "vector", "id"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, f"_key {types['_key']}, _label {types['_label']}, vector {kind}, id binary")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(``key``, ``n_links``, ``component_id``, ``kept``) of every row.

    Rows link if their labels are equal and not null, their widths are equal and their cosine
    is at least ``threshold``, which must be positive.  Vectors that are null, empty or zero
    or hold a null or an infinite or undefined component link with nothing.  ``n_links`` counts
    the other rows linked directly; ``component_id`` is the least key a row reaches, itself
    included, and ``kept`` says that it is the row's own.
    """
    kind = dict(vectors.dtypes)[vector]
    chosen = vectors.select(field(vectors, key).alias("_key"), field(vectors, label).alias("_label"),
                            field(vectors, vector).alias("vector"))
    rows = materialize(_identified(chosen, kind), "vectors")
    valid = rows.where(F.col("id").isNotNull())
    different = materialize(
        valid.groupBy("id").agg(F.first("_label").alias("label"), F.first("vector").alias("vector"),
                                F.count("*").alias("copies"), F.min("_key").alias("least"))
        .withColumns({"width": F.size("vector"), "none": F.col("least").isNull()}), "different-vectors")
    sizes = different.groupBy("label", "width").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    number = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    cut = materialize(
        different.join(sizes, ["label", "width"]).withColumn("tile", number)
        .groupBy("label", "width", "tiles", "tile")
        .agg(F.sort_array(F.collect_list(F.struct("id", "copies", "vector", "none", "least"))).alias("rows")), "vector-tiles")
    long = F.greatest(F.lit(1), F.least(F.ceil(F.col("tiles") / F.lit(_SIDE)),
                                        F.floor(F.lit(STRIP_BYTES / (8 * tile)) / F.col("width")))).cast("int")
    strips = cut.withColumn("strip", F.floor(F.col("tile") / long)).withColumn(
        "last", F.floor((F.col("tiles") - 1) / long))
    cell = ["label", "width", "home", "other"]
    ours = strips.select("label", "width", F.col("strip").alias("home"),
                         F.explode(F.sequence("strip", "last")).alias("other"), "rows")
    before = F.when(F.col("strip") > 0, F.sequence(F.lit(0).cast("long"), F.col("strip") - 1))
    theirs = strips.select("label", "width", F.explode(before).alias("home"), F.col("strip").alias("other"), "rows")
    theirs = theirs.toDF(*theirs.columns)
    node = f"struct<none:boolean,least:{dict(rows.dtypes)['_key']},id:binary>"
    schema = f"a {node}, b {node}, links long"
    none = pa.Table.from_batches([], to_arrow_schema(StructType.fromDDL(schema)))
    found = materialize(ours.groupBy(*cell).cogroup(theirs.groupBy(*cell)).applyInArrow(
        _compare(threshold, none), schema), "vector-links")
    links = found.groupBy(F.col("a.id").alias("id")).agg(F.sum("links").alias("links"))
    linked = components(found.select("a", "b")).select(F.col("node.id").alias("id"), F.col("root.least").alias("first"))
    known = different.select("id", "copies", "least").join(linked, "id", "left").join(links, "id", "left").select(
        "id", F.coalesce("first", "least").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = materialize(known, "vector-classes")
    whole = rows.select("_key", "id").join(known, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("_key")).otherwise(F.col("component_id"))
    return whole.select(
        F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("_key") == component, F.lit(False)).alias("kept"))
