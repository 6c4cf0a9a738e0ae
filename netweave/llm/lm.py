"""Texts scored by a hierarchical Pitman-Yor model of words, learned from a whole corpus.

A token is a word (A-Z lowered) or a text's end.  The class of the token before it, 16 bits
of that token's hash, chooses the restaurant that serves it; all context restaurants share one
parent, the restaurant of single words, above which every known word and the unknown one are
equally likely.  Discounts come from counts of counts.

Seating is sampled by Gibbs sweeps.  A sweep empties, for each dish, the tables of its restaurant
and seats its customers again given all other tables: one after another at first, then in parties
of at most an eighth of those seated, so a dish of any number of customers takes rounds in its
logarithm and the memory of one number.  The new seating replaces the old one by the ratio of
their weights, which corrects for the order of arrival.  All dishes of a sweep move side by side.
Probabilities are averaged over the seatings of the last sweeps, each with its own totals, so that
they add up to one.

On Spark: tasks turn slices of documents into packed counts of (word, class, document), which
meet by word in about as many buckets as there are ``BUCKET_BYTES`` of text; buckets are written
once and read by each pass.  Of every bucket only sums by class and by document leave it.  A word
that a sample of documents shows to be one in ``HOT`` tokens is dealt by slice instead; its counts
are added up by class and its probabilities, one vector for each of at most ``HOT`` words,
broadcast.  The sample decides where rows go, never a result.  Words are told apart by 64-bit hashes.

Null texts are empty, an empty text is its end alone, repeated rows are scored each, an empty
table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from netweave.llm.base import TEXT, field, slices, text_buffers
from netweave.session import materialize

CLASSES = 1 << 16
#: Bytes of text for one bucket, of one slice, and hashed at a time.
BUCKET_BYTES = 4 << 20
SLICE = 8 << 20
PIECE = 1 << 19
#: A word of at least this share of the sampled tokens (one in ...) is dealt by slice.
HOT = 256
#: One document in this many decides which words are hot.
SAMPLED = 64
BURN_IN, SAMPLES = 3, 4
STRENGTH = 1.0
#: Documents whose sums one task holds before it passes them on.
HELD_DOCUMENTS = 300_000

START, END = np.uint64(0x51A27C0DE5A17B03), np.uint64(0xE4D0F7E871A9C2B5)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


# --- tokens ----------------------------------------------------------------------------

def _powers(base: np.uint64, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Words of byte strings as 64-bit hashes, ``PIECE`` bytes or one long word at a time."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, PIECE), _powers(_INVERSE, PIECE)

    def words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and start places of the maximal runs without blanks."""
        blank = _BLANK[raw]
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        hashes = np.zeros(len(starts), np.uint64)
        done = 0
        while done < len(starts):
            first = starts[done]
            last = max(int(np.searchsorted(ends, first + PIECE, "right")), done + 1)
            size = int(ends[last - 1] - first)
            if size > len(self.up):
                self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_LOWER[raw[first:first + size]] * self.up[:size], out=sums[1:])
            a, b = starts[done:last] - first, ends[done:last] - first
            h = (sums[b] - sums[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            hashes[done:last] = h ^ (h >> np.uint64(31))
            done = last
        return hashes, starts

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all texts in their order, the class before each, and each one's text."""
        raw, at = text_buffers(texts)
        n = len(texts)
        # A blank after every text keeps its last word from the next text's first.
        spread = np.full(int(at[-1] - at[0]) + n, 32, np.uint8)
        sizes = np.diff(at)
        begins = (at[:-1] - at[0]) + np.arange(n)
        inside = np.ones(len(spread), bool)
        inside[begins + sizes] = False
        spread[inside] = raw[at[0]:at[-1]]
        hashes, starts = self.words(spread)
        owner = np.searchsorted(begins, starts, "right") - 1
        words = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
        token = np.empty(len(hashes) + n, np.uint64)
        place = np.arange(len(hashes)) + owner
        token[place] = hashes
        ends = np.cumsum(words + 1) - 1
        token[ends] = END
        text = np.repeat(np.arange(n), words + 1)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[ends - words] = START
        return token, (before >> np.uint64(48)).astype(np.int64), text


# --- packed columns ----------------------------------------------------------------------

def pack(*columns: np.ndarray) -> bytes:
    """Columns as one compressed string; the bytes of equal rank lie together."""
    head = [struct.pack("<i", len(columns))]
    body = []
    for c in columns:
        head.append(c.dtype.str.encode().ljust(8) + struct.pack("<q", len(c)))
        body.append(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<i", raw)[0]
    at, out = 4 + 16 * n, []
    for i in range(n):
        kind = np.dtype(raw[4 + 16 * i:12 + 16 * i].decode().strip())
        size = struct.unpack_from("<q", raw, 12 + 16 * i)[0]
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours starts."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def added(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


# --- from documents to buckets -------------------------------------------------------------

def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets


def _bucketed(docs: DataFrame, key: str, text: str, train: Column, buckets: int, hot: list[int]) -> DataFrame:
    """One row per bucket (``room``), and one per document (``chunk``, ``idx``, its key, ``held_out``, ``n_tokens``)."""
    kind = docs.schema[key].dataType
    narrow = docs.select(field(docs, key).alias("id"), F.coalesce(train, F.lit(False)).alias("train"),
                         F.coalesce(field(docs, text).cast("string"), F.lit("")).alias(TEXT))
    marked = np.array(sorted(hot), np.uint64)
    sent = StructType.fromDDL("bucket int, chunk bigint, blob binary, idx int").add(StructField("id", kind)).add(
        "held_out", "boolean").add("n_tokens", "long")

    def rows_of(chunk: int, part: pa.RecordBatch, hasher: Hasher) -> Iterator[pa.RecordBatch]:
        trained = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
        token, before, owner = hasher.tokens(part.column(2))
        # Training documents come first in a slice, so that a document's number says which it is.
        number = np.empty(len(trained), np.int64)
        number[np.argsort(~trained, kind="stable")] = np.arange(len(trained))
        words, at = np.unique(token, return_inverse=True)
        goes = bucket_of(words, buckets)
        home = ((chunk >> 40) * 2654435761 + (chunk & 0xFFFFFFFF)) % buckets
        goes[np.isin(words, marked)] = home
        order = np.argsort(goes, kind="stable")
        rank = np.empty(len(words), np.uint64)
        rank[order] = np.arange(len(words), dtype=np.uint64)
        joint = (rank[at] << np.uint64(32)) | (before.astype(np.uint64) << np.uint64(16)) | number[owner].astype(np.uint64)
        joint.sort()
        first = runs(joint)
        count = np.diff(np.concatenate([first, [len(joint)]])).astype(np.uint32)
        joint = joint[first]
        place = (joint >> np.uint64(32)).astype(np.int64)
        words, goes = words[order], goes[order]
        row_at = np.searchsorted(place, np.arange(len(words) + 1))
        ids, blobs = [], []
        cut = np.concatenate([runs(goes), [len(goes)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            x, y = int(row_at[a]), int(row_at[b])
            ids.append(int(goes[a]))
            blobs.append(pack(np.array([int(trained.sum())], np.int64), words[a:b],
                              np.diff(row_at[a:b + 1]).astype(np.uint32),
                              ((joint[x:y] >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16),
                              (joint[x:y] & np.uint64(0xFFFF)).astype(np.uint16), count[x:y]))
        n, m = len(ids), len(trained)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int32()),
             pa.nulls(n, part.column(0).type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64())], names=sent.names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([home] * m, pa.int32()), pa.array([chunk] * m, pa.int64()), pa.nulls(m, pa.binary()),
             pa.array(number, pa.int32()), part.column(0), pa.array(~trained),
             pa.array(np.bincount(owner, minlength=m), pa.int64())], names=sent.names)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, chunk = Hasher(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, SLICE):
                for a in range(0, part.num_rows, 1 << 16):
                    yield from rows_of(chunk, part.slice(a, 1 << 16), hasher)
                    chunk += 1

    kept = StructType.fromDDL("bucket int, room binary, chunk bigint, idx int").add(StructField("id", kind)).add(
        "held_out", "boolean").add("n_tokens", "long")

    def gather(rows: pa.Table) -> pa.Table:
        packed = rows.filter(pc.is_valid(rows.column("blob")))
        people = rows.filter(pc.is_null(rows.column("blob")))
        n = 1 if packed.num_rows else 0
        room = [gathered(packed.column("chunk").to_pylist(), packed.column("blob").to_pylist())] if n else []
        whole = {"bucket": pa.chunked_array([rows.column("bucket").combine_chunks()[:n], *people.column("bucket").chunks]),
                 "room": pa.array(room + [None] * people.num_rows, pa.binary())}
        for name in ("chunk", "idx", "id", "held_out", "n_tokens"):
            column = people.column(name)
            whole[name] = pa.chunked_array([pa.nulls(n, column.type), *column.chunks], column.type)
        return pa.table(whole)

    return narrow.mapInArrow(send, sent).groupBy("bucket").applyInArrow(gather, kept)


def gathered(chunks: list[int], blobs: list[bytes]) -> bytes:
    """The rows of one bucket by word and class, packed."""
    words, sizes, klass, doc, count, trained, chunk = [], [], [], [], [], [], []
    for i, blob in enumerate(blobs):
        limit, w, per_word, k, d, n = unpack(blob)
        words.append(w)
        sizes.append(per_word)
        klass.append(k)
        doc.append(d)
        count.append(n)
        trained.append(d < limit[0])
        chunk.append(np.full(len(k), i, np.uint32))
    known, where = np.unique(np.concatenate(words), return_inverse=True)
    word = np.repeat(where, np.concatenate(sizes))
    joint = (word << 16) | np.concatenate(klass)
    order = np.argsort(joint, kind="stable")
    joint = joint[order]
    starts = runs(joint)
    count = np.concatenate(count)[order]
    served = np.where(np.concatenate(trained)[order], count, 0).astype(np.int64)
    dishes = joint[starts]
    return pack(known, (dishes >> 16).astype(np.uint32), (dishes & 0xFFFF).astype(np.uint16), added(served, starts),
                np.diff(np.concatenate([starts, [len(joint)]])).astype(np.uint32), np.array(chunks, np.int64),
                np.concatenate(chunk)[order], np.concatenate(doc)[order], count)


@dataclass
class Room:
    """A bucket: words, dishes (word, class, customers), and the documents that hold them."""

    words: np.ndarray
    word: np.ndarray
    klass: np.ndarray
    customers: np.ndarray
    rows: np.ndarray
    chunks: np.ndarray
    chunk: np.ndarray
    doc: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(blob: bytes) -> Room:
        words, word, klass, customers, *rest = unpack(blob)
        return Room(words, word.astype(np.int64), klass.astype(np.int64), customers, *rest)


# --- seating -----------------------------------------------------------------------------

def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables of dishes whose customers arrive anew, and the logarithms of the seatings' weights.

    ``weight`` is that of a new table.  A seating comes up in proportion to its probability
    divided by the product of the totals that its customers met; that product is its weight.
    """
    tables, logs = np.ones(len(customers), np.int64), np.zeros(len(customers))
    seated = np.ones(len(customers), np.int64)
    live = np.flatnonzero(customers > 1)
    while len(live):
        n, t, a = seated[live], tables[live], weight[live]
        party = np.minimum(np.maximum(n // 8, 1), customers[live] - n)
        total = a + n - discount * t
        share = a / total
        single = party == 1
        new = np.empty(len(live), np.int64)
        new[single] = rng.random(int(single.sum())) < share[single]
        new[~single] = rng.binomial(party[~single], share[~single])
        logs[live] += party * np.log(total)
        tables[live] = t + new
        seated[live] = n + party
        live = live[seated[live] < customers[live]]
    return tables, logs


@dataclass(frozen=True)
class Totals:
    """Figures of the whole corpus: tokens and words of the training part, customers and dishes by class,
    discounts of contexts and of the parent."""

    tokens: int
    words: int
    customers: np.ndarray
    dishes: np.ndarray
    discount: float
    parent_discount: float


def seatings(word: np.ndarray, klass: np.ndarray, customers: np.ndarray, words: int, totals: Totals,
             seed: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kept sweep: tables of the dishes, and customers and tables of the words in the parent."""
    rng = np.random.default_rng(list(seed))
    d, d0 = totals.discount, totals.parent_discount
    many = np.flatnonzero(customers > 1)
    tables = (customers > 0).astype(np.int64)
    logs = np.full(len(many), -np.inf)
    dishes, known = max(int(tables.sum()), 1), max(int(len(np.unique(word[customers > 0]))), 1)
    above = np.bincount(word, tables, words).astype(np.int64)
    parent = (above > 0).astype(np.int64)
    parent_logs, parent_for = np.full(words, -np.inf), np.full(words, -1)
    floor = 1 / (totals.words + 1)
    whole = float(totals.dishes.sum())
    for sweep in range(BURN_IN + SAMPLES):
        # Totals of other buckets follow this one's share of tables per dish.
        grown, parent_grown = tables.sum() / dishes, parent.sum() / known
        base = (STRENGTH + d0 * totals.words * parent_grown) * floor
        own = tables[many]
        others = above[word[many]] - own
        spread = np.maximum(others - d0 * np.minimum(parent[word[many]], others), 0) + base
        likely = spread / (STRENGTH + whole * grown)
        weight = (STRENGTH + d * np.maximum(totals.dishes[klass[many]] * grown - own, 0)) * likely
        proposed, fresh = seat(customers[many], weight, d, rng)
        taken = np.log(rng.random(len(many))) < fresh - logs
        tables[many] = np.where(taken, proposed, own)
        logs = np.where(taken, fresh, logs)
        above = np.bincount(word, tables, words).astype(np.int64)
        proposed, fresh = seat(above, np.full(words, base), d0, rng)
        taken = (above != parent_for) | (np.log(rng.random(words)) < fresh - parent_logs)
        parent = np.where(above > 0, np.where(taken, proposed, parent), 0)
        parent_logs, parent_for = np.where(taken, fresh, parent_logs), above
        if sweep >= BURN_IN:
            yield tables, above, parent


@dataclass(frozen=True)
class Sample:
    """Totals of one kept sweep: tables by class, and customers and tables of the parent."""

    tables: np.ndarray
    above: float
    parent: float


def averaged(room_words: int, word: np.ndarray, klass: np.ndarray, customers: np.ndarray, totals: Totals,
             samples: list[Sample], seed: tuple[int, ...]) -> np.ndarray:
    """The mean over the kept sweeps of the probability of each dish after its class."""
    out = np.zeros(len(word))
    for s, (tables, above, parent) in zip(samples, seatings(word, klass, customers, room_words, totals, seed)):
        out += probability(word, klass, customers, tables, above, parent, totals, s)
    return out / len(samples)


def probability(word, klass, customers, tables, above, parent, totals: Totals, s: Sample) -> np.ndarray:
    d, d0 = totals.discount, totals.parent_discount
    single = (above - d0 * parent + (STRENGTH + d0 * s.parent) / (totals.words + 1)) / (STRENGTH + s.above)
    held = totals.customers[klass]
    return (customers - d * tables + (STRENGTH + d * s.tables[klass]) * single[word]) / (STRENGTH + held)


# --- passes over the buckets -----------------------------------------------------------------

def _by_class(values: np.ndarray, klass: np.ndarray) -> np.ndarray:
    return np.bincount(klass, values, CLASSES)


def _hot_words(docs: DataFrame, key: str, text: str) -> list[int]:
    """Words that are at least one in ``HOT`` tokens of a sample of the documents: at most ``HOT``."""
    chosen = F.pmod(F.xxhash64(field(docs, key).cast("string")), F.lit(SAMPLED)) == 0
    narrow = docs.where(chosen).select(F.coalesce(field(docs, text).cast("string"), F.lit("")).alias(TEXT))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, SLICE):
                token, _, _ = hasher.tokens(part.column(0))
                words, n = np.unique(token, return_counts=True)
                often = n * 4 * HOT >= len(token)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(words[often].view(np.int64), 0)), pa.array(np.append(n[often], 0)),
                     pa.array(np.append(np.zeros(int(often.sum()), np.int64), len(token)))], names=["w", "n", "tokens"])

    counted = narrow.mapInArrow(run, "w bigint, n bigint, tokens bigint").groupBy("w").agg(
        F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    whole = counted.agg(F.sum("tokens")).first()[0] or 0
    rows = counted.where(F.col("n") * HOT >= max(whole, 1)).orderBy(F.desc("n")).limit(HOT).collect()
    return [r["w"] & 0xFFFFFFFFFFFFFFFF for r in rows]


def _hot_dishes(rooms: DataFrame, hot: list[int]) -> DataFrame:
    """Training counts (``w``, ``k``, ``c``) of the hot words."""
    marked = np.array(sorted(hot), np.uint64)

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                room = Room.of(blob.as_py())
                mine = np.isin(room.words, marked)[room.word]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(room.words[room.word[mine]].view(np.int64)), pa.array(room.klass[mine].astype(np.int32)),
                     pa.array(room.customers[mine])], names=["w", "k", "c"])

    return rooms.select("room").mapInArrow(run, "w bigint, k int, c bigint").groupBy("w", "k").agg(F.sum("c").alias("c"))


def _own(blob: bytes, marked: np.ndarray) -> Room:
    """A bucket in which hot words, whose counts are elsewhere, have no customers."""
    room = Room.of(blob)
    room.customers = np.where(np.isin(room.words, marked)[room.word], 0, room.customers)
    return room


_SUMS = "sample int, k int, a double, b double"


def _sums(sample: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero((a != 0) | (b != 0))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(at), sample, np.int32)), pa.array(at.astype(np.int32)),
         pa.array(a[at].astype(float)), pa.array(b[at].astype(float))], names=["sample", "k", "a", "b"])


def _facts(word, klass, customers, words) -> list[np.ndarray]:
    """Customers and dishes by class, and in the two places beyond: [tokens, words, dishes of one, of two
    customers, words of one, of two dishes]."""
    known = customers > 0
    per_word = np.bincount(word[known], minlength=words)
    extra = [customers.sum(), (per_word > 0).sum(), (customers == 1).sum(), (customers == 2).sum(),
             (per_word == 1).sum(), (per_word == 2).sum()]
    return [np.append(_by_class(customers, klass), extra), np.append(_by_class(known, klass), np.zeros(6))]


def _collected(parts: DataFrame, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums by sample and place: at most ``width`` of them a sample."""
    table = parts.groupBy("sample", "k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sample = table.column("sample").to_numpy()
    for s in np.unique(sample).tolist():
        mine = sample == s
        a, b = np.zeros(width), np.zeros(width)
        k = table.column("k").to_numpy()[mine]
        a[k], b[k] = table.column("a").to_numpy()[mine], table.column("b").to_numpy()[mine]
        out[s] = (a, b)
    return out


def _word_groups(hot_dishes: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(word, class, customers)`` for each hot word; its dishes are at most the classes."""
    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("k").to_numpy())
        return fn(int(rows.column("w")[0].as_py()), rows.column("k").to_numpy()[order].astype(np.int64),
                  rows.column("c").to_numpy()[order])

    return hot_dishes.groupBy("w").applyInArrow(run, schema)


def _seed(word: int) -> tuple[int, ...]:
    return (7, word & 0xFFFFFFFF, (word >> 32) & 0xFFFFFFFF)


def score_texts(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text",
                buckets: int | None = None, hot: list[int] | None = None) -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every document.

    The model learns from all documents where ``train`` holds.  ``score`` is the base-10
    logarithm of the text's probability, ``base_score`` that of smoothed single-word counts.
    ``buckets`` and ``hot`` (hashes of words dealt by slice) change the plan only.
    """
    spark = docs.sparkSession
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(field(docs, text).cast("string")))).first()[0] or 0
        buckets = max(8, -(-size // BUCKET_BYTES))
    hot = _hot_words(docs, key, text) if hot is None else hot
    marked = np.array(sorted(hot), np.uint64)
    table = materialize(_bucketed(docs, key, text, train, buckets, hot), "rooms")
    rooms = table.where("room is not null").select("bucket", "room")
    dishes = materialize(_hot_dishes(rooms, hot), "hot-dishes")

    def each_room(batches):
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield bucket, _own(blob.as_py(), marked)

    def facts(batches):
        for _, room in each_room(batches):
            yield _sums(0, *_facts(room.word, room.klass, room.customers, len(room.words)))

    def hot_facts(word, klass, customers):
        return pa.Table.from_batches([_sums(0, *_facts(np.zeros(len(klass), np.int64), klass, customers, 1))])

    a, b = _collected(rooms.mapInArrow(facts, _SUMS).unionByName(_word_groups(dishes, hot_facts, _SUMS)), CLASSES + 6).get(
        0, (np.zeros(CLASSES + 6), np.zeros(CLASSES + 6)))
    tokens, words, ones, twos, word_ones, word_twos = a[CLASSES:]
    totals = Totals(int(tokens), int(words), a[:CLASSES], b[:CLASSES], _discount(ones, twos), _discount(word_ones, word_twos))

    def tables_of(words, word, klass, customers, seed):
        for i, (tables, above, parent) in enumerate(seatings(word, klass, customers, words, totals, seed)):
            yield _sums(i, np.append(_by_class(tables, klass), above.sum()), np.append(np.zeros(CLASSES), parent.sum()))

    def sampled(batches):
        for bucket, room in each_room(batches):
            yield from tables_of(len(room.words), room.word, room.klass, room.customers, (11, bucket))

    def hot_sampled(word, klass, customers):
        return pa.Table.from_batches(tables_of(1, np.zeros(len(klass), np.int64), klass, customers, _seed(word)))

    got = _collected(rooms.mapInArrow(sampled, _SUMS).unionByName(_word_groups(dishes, hot_sampled, _SUMS)), CLASSES + 1)
    nobody = (np.zeros(CLASSES + 1), np.zeros(CLASSES + 1))
    samples = [Sample(a[:CLASSES], a[CLASSES], b[CLASSES]) for a, b in (got.get(i, nobody) for i in range(SAMPLES))]

    def hot_likely(word, klass, customers):
        # A last word without customers says what classes give that the word never followed.
        every = np.arange(CLASSES)
        full = np.zeros(CLASSES, np.int64)
        full[klass] = customers
        p = np.zeros(CLASSES)
        for s, (tables, above, parent) in zip(samples, seatings(np.zeros(len(klass), np.int64), klass, customers, 1, totals, _seed(word))):
            spread = np.zeros(CLASSES, np.int64)
            spread[klass] = tables
            p += probability(np.zeros(CLASSES, np.int64), every, full, spread, above, parent, totals, s)
        return pa.table({"w": [word], "c": [int(customers.sum())], "p": pa.array([(p / len(samples)).tobytes()], pa.binary())})

    vectors = {r["w"] & 0xFFFFFFFFFFFFFFFF: (r["c"], np.frombuffer(bytes(r["p"])))
               for r in _word_groups(dishes, hot_likely, "w bigint, c bigint, p binary").collect()}
    shared = spark.sparkContext.broadcast((totals, samples, vectors))

    def scored(batches):
        totals, samples, vectors = shared.value
        held = Sums()
        for bucket, room in each_room(batches):
            p = averaged(len(room.words), room.word, room.klass, room.customers, totals, samples, (11, bucket))
            c = np.bincount(room.word, room.customers, len(room.words))
            for i in np.flatnonzero(np.isin(room.words, marked)).tolist():
                n, vector = vectors[int(room.words[i])]
                mine = room.word == i
                c[i], p[mine] = n, vector[room.klass[mine]]
            plain = np.log10((c + 0.5) / (totals.tokens + 0.5 * (totals.words + 1)))[room.word]
            known = (c > 0)[room.word].astype(float)
            each = [np.repeat(v, room.rows) * room.count for v in (known, plain, np.log10(p))]
            yield from held.add(room.chunks, room.chunk, room.doc, each)
        yield from held.taken()

    parts = rooms.mapInArrow(scored, "chunk bigint, sums binary")
    people = table.where("room is null").select("chunk", "idx", "id", "held_out", "n_tokens")
    kept = StructType([StructField("id", docs.schema[key].dataType)]).add("held_out", "boolean").add("n_tokens", "long").add(
        "known", "long").add("base", "double").add("score", "double")
    whole = people.groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(_settled, kept)
    return whole.select(F.col("id").alias(key), "held_out", "n_tokens", F.col("known").alias("n_known"),
                        F.lit(totals.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def _settled(people: pa.Table, parts: pa.Table) -> pa.Table:
    """The documents of one slice with their sums."""
    place = people.column("idx").to_numpy()
    sums = np.zeros((3, int(place.max()) + 1 if len(place) else 0))
    for blob in parts.column("sums"):
        idx, *values = unpack(blob.as_py())
        for total, v in zip(sums, values):
            total[idx] += v
    out = people.select(["id", "held_out", "n_tokens"])
    out = out.append_column("known", pa.array(sums[0][place].astype(np.int64)))
    return out.append_column("base", pa.array(sums[1][place])).append_column("score", pa.array(sums[2][place]))


def _discount(ones: float, twos: float) -> float:
    """The discount that counts of counts suggest."""
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))


class Sums:
    """Sums by document, added up over buckets while they fit and passed on packed by slice."""

    def __init__(self) -> None:
        self.chunks: dict[int, int] = {}
        self.parts: list[tuple[np.ndarray, list[np.ndarray]]] = []
        self.size = 0

    def add(self, chunks: np.ndarray, chunk: np.ndarray, doc: np.ndarray, values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        local = np.array([self.chunks.setdefault(c, len(self.chunks)) for c in chunks.tolist()], np.int64)
        self._keep((local[chunk] << 16) | doc, values)
        if self.size > HELD_DOCUMENTS:
            keys = np.concatenate([k for k, _ in self.parts])
            columns = [np.concatenate([v[i] for _, v in self.parts]) for i in range(3)]
            self.parts, self.size = [], 0
            self._keep(keys, columns)
            if self.size > HELD_DOCUMENTS // 2:
                yield from self.taken()

    def _keep(self, keys: np.ndarray, values: list[np.ndarray]) -> None:
        some, at = np.unique(keys, return_inverse=True)
        self.parts.append((some, [np.bincount(at, v, len(some)) for v in values]))
        self.size += len(some)

    def taken(self) -> Iterator[pa.RecordBatch]:
        """One row for each slice; nothing is held afterwards."""
        if not self.parts:
            return
        keys = np.concatenate([k for k, _ in self.parts])
        columns = [np.concatenate([v[i] for _, v in self.parts]) for i in range(3)]
        order = np.argsort(keys >> 16, kind="stable")
        keys, columns = keys[order], [c[order] for c in columns]
        cut = np.append(runs(keys >> 16), len(keys))
        names = list(self.chunks)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            some, at = np.unique(keys[a:b] & 0xFFFF, return_inverse=True)
            blob = pack(some.astype(np.uint16), *[np.bincount(at, c[a:b], len(some)) for c in columns])
            yield pa.RecordBatch.from_arrays([pa.array([names[int(keys[a] >> 16)]], pa.int64()), pa.array([blob], pa.binary())],
                                             names=["chunk", "sums"])
        self.chunks, self.parts, self.size = {}, [], 0
