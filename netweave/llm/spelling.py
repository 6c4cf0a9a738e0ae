"""Spelling variants: words of a corpus that differ by one letter, found through Bloom filters.

Every word tries its edits (one letter deleted, or replaced by a later one; an insertion is
the other word's deletion) on blocked Bloom filters of the vocabulary, one per word length.
Only edits that a filter admits are shuffled, as hashes, to a join with the vocabulary; a
comparison of the two words then removes what was let through by mistake.  Filters hold 16
bits a word and travel in batches of at most ``BATCH_BLOCKS`` blocks (64 MB); a vocabulary
that needs more is probed batch after batch, a length of too many words in several parts.

Null texts hold no words; a null key counts as the empty text; repeated rows count each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.base import TEXT, each_bytes, field, slices
from netweave.session import materialize

#: Runs of letters, and how a run is damaged.
MIN_LETTERS = 6
DAMAGE = 199
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z lowered; U+00C0 to U+00FF are the byte C3 and one of 80 to BF.
_RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % MIN_LETTERS)

#: Words counted by one task before it passes its counts on.
HELD_WORDS = 500_000
#: Words of one Bloom block (512 bits), blocks of one segment, and blocks of one broadcast batch.
BLOCK_WORDS = 32
SEGMENT = 4096
BATCH_BLOCKS = 1 << 20
PROBES = 6
#: Edits hashed at a time.
CELLS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def damaged(word: bytes, code: int) -> bytes:
    """The word without its letter ``code % length``."""
    letters = word.decode()
    at = code % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5) -> DataFrame:
    """(``word``, ``n``) of words with at least ``least`` occurrences over all documents.

    Runs are counted per document, then per task, before anything is shuffled.
    """
    ident = F.coalesce(field(docs, key).cast("string"), F.lit(""))
    narrow = docs.select(ident.alias("_key"), F.coalesce(field(docs, text).cast("string"), F.lit("")).alias(TEXT))

    def batch_of(counts: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode() for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for ident, body in zip(part.column(0).to_pylist(), each_bytes(part.column(1))):
                    start = crc32(f"{ident}:".encode())
                    for word, n in Counter(_RUNS.findall(body.translate(_LOWER))).items():
                        code = crc32(word, start)
                        if code % DAMAGE == 0:
                            word = damaged(word, code)
                            if len(word.decode()) < MIN_LETTERS:
                                continue
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield batch_of(held)
                    held = Counter()
        yield batch_of(held)

    counted = narrow.mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- hashes ----------------------------------------------------------------------------

def letters_of(words: list[str], length: int) -> np.ndarray:
    """Code points, one row per word of ``length`` letters."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)


def powers(length: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, _BASE, np.uint64)]), dtype=np.uint64)


def mixed(sums: np.ndarray, length: int) -> np.ndarray:
    """Well spread 64-bit hashes of polynomial sums over words of ``length`` letters."""
    h = sums + np.uint64((length * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Each length in ``words`` and the places of its words."""
    sizes = np.array([len(w) for w in words], np.int64)
    for length in np.unique(sizes).tolist():
        yield length, np.flatnonzero(sizes == length)


def word_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and lengths of words."""
    hashes, sizes = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int32)
    for length, at in by_length(words):
        power = powers(length)[:length]
        step = max(1, CELLS // max(length, 1))
        for a in range(0, len(at), step):
            some = at[a:a + step]
            letters = letters_of([words[i] for i in some], length)
            hashes[some] = mixed((letters * power).sum(1, dtype=np.uint64), length)
        sizes[at] = length
    return hashes, sizes


# --- filters ---------------------------------------------------------------------------

def plan_batches(counts: dict[int, int], limit: int = BATCH_BLOCKS, per_block: int = BLOCK_WORDS) -> list[dict]:
    """Batches of filters: ``{(length, part): (parts, first block, blocks)}``, at most ``limit`` blocks each."""
    batches: list[dict] = [{}]
    used = 0
    for length, n in sorted(counts.items()):
        blocks = -(-n // per_block)
        parts = -(-blocks // limit)
        size = -(-blocks // parts)
        for part in range(parts):
            if used + size > limit and batches[-1]:
                batches.append({})
                used = 0
            batches[-1][(length, part)] = (parts, used, size)
            used += size
    return batches


def shard_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(7)) & np.uint64(0xFFFF)).astype(np.int64) % parts


def block_of(hashes: np.ndarray, first: int, blocks: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64) + first


def bits_of(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each probe the word (0 to 7) of the block and the bit in it."""
    spread = hashes * np.uint64(0xD6E8FEB86659FD93)
    for i in range(PROBES):
        nine = (spread >> np.uint64(9 * i + 1)) & np.uint64(511)
        yield (nine >> np.uint64(6)).astype(np.int64), np.uint64(1) << (nine & np.uint64(63))


def built_filter(vocabulary: DataFrame, batch: dict) -> np.ndarray:
    """The filters of one batch, each segment built by one task, as one array of 8 words a block."""
    lengths = sorted({length for length, _ in batch})
    total = max(first + blocks for _, first, blocks in batch.values())

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            h = rows.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = rows.column(1).to_numpy(zero_copy_only=False)
            for (length, part), (parts, first, blocks) in batch.items():
                mine = h[sizes == length]
                mine = mine[shard_part(mine, parts) == part]
                block = block_of(mine, first, blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block // SEGMENT), pa.array(block % SEGMENT), pa.array(mine.view(np.int64))],
                    names=["segment", "block", "h"])

    def build(rows: pa.Table) -> pa.Table:
        h = rows.column("h").to_numpy().view(np.uint64)
        block = rows.column("block").to_numpy()
        words = np.zeros(SEGMENT * 8, np.uint64)
        for word, bit in bits_of(h):
            np.bitwise_or.at(words, block * 8 + word, bit)
        return pa.table({"segment": rows.column("segment")[:1], "bits": pa.array([words.tobytes()], pa.binary())})

    placed = vocabulary.where(F.col("length").isin(lengths)).select("h", "length").mapInArrow(
        place, "segment bigint, block bigint, h bigint")
    found = placed.groupBy("segment").applyInArrow(build, "segment bigint, bits binary").toArrow()
    out = np.zeros(-(-total // SEGMENT) * SEGMENT * 8, np.uint64)
    for segment, bits in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        out[segment * SEGMENT * 8:(segment + 1) * SEGMENT * 8] = np.frombuffer(bits, np.uint64)
    return out


def admitted(hashes: np.ndarray, length: int, batch: dict, words: np.ndarray) -> np.ndarray:
    """Places in ``hashes`` (of edits of ``length`` letters) that the batch's filters admit."""
    parts = next((p for (size, _), (p, _, _) in batch.items() if size == length), 0)
    out = []
    shard = shard_part(hashes, parts) if parts > 1 else None
    for part in range(parts):
        if (length, part) not in batch:
            continue
        _, first, blocks = batch[(length, part)]
        at = np.arange(len(hashes)) if shard is None else np.flatnonzero(shard == part)
        base = block_of(hashes[at], first, blocks) * 8
        for i in range(PROBES):
            nine = ((hashes[at] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(9 * i + 1)) & np.uint64(511)
            hit = (words[base + (nine >> np.uint64(6)).astype(np.int64)] >> (nine & np.uint64(63))) & np.uint64(1) != 0
            at, base = at[hit], base[hit]
        out.append(at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def edits(letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Rows of ``letters``, hashes of their edits, and the edits' length, ``CELLS`` or so at a time."""
    rows, length = letters.shape
    power = powers(length)
    terms = letters * power[:length]
    total = terms.sum(1, dtype=np.uint64)
    before = np.cumsum(terms, axis=1, dtype=np.uint64)
    # A letter left out: what follows it moves one place down.
    gone = (before - terms) + (total[:, None] - before) * _INVERSE
    yield np.repeat(np.arange(rows), length), mixed(gone.ravel(), length - 1), length - 1
    step = max(1, CELLS // max(rows * len(alphabet), 1))
    for a in range(0, length, step):
        old = letters[:, a:a + step, None]
        later = alphabet[None, None, :] > old
        sums = total[:, None, None] + (alphabet[None, None, :] - old) * power[a:a + step][None, :length - a, None]
        yield np.nonzero(later)[0], mixed(sums[later], length), length


def candidate_pairs(vocabulary: DataFrame, alphabet: list[int], batch: dict) -> DataFrame:
    """(``id``, ``h``, ``length``): edits of vocabulary words that the batch's filters admit."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(built_filter(vocabulary, batch))
    lengths = {length for length, _ in batch}
    signs = np.array(alphabet, np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for rows in batches:
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            texts = rows.column(1).to_pylist()
            for length, at in by_length(texts):
                step = max(1, CELLS // (length * len(signs)))
                for a in range(0, len(at), step):
                    some = at[a:a + step]
                    letters = letters_of([texts[i] for i in some], length)
                    for source, hashes, size in edits(letters, signs):
                        if size not in lengths:
                            continue
                        hit = admitted(hashes, size, batch, words)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[some[source[hit]]]), pa.array(hashes[hit].view(np.int64)),
                             pa.array(np.full(len(hit), size, np.int32))], names=["id", "h", "length"])

    near = sorted(lengths | {n + 1 for n in lengths})
    return vocabulary.where(F.col("length").isin(near)).select("id", "word").mapInArrow(
        run, "id bigint, h bigint, length int")


# --- groups ----------------------------------------------------------------------------

def hashed_vocabulary(words: DataFrame) -> DataFrame:
    """``words`` (``word``, ``n``) written with an ``id``, the word's hash ``h`` and its ``length``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            h, sizes = word_hashes(rows.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(h.view(np.int64)), pa.array(sizes)],
                                             names=["word", "n", "h", "length"])

    made = words.select("word", "n").mapInArrow(run, "word string, n bigint, h bigint, length int")
    return materialize(made.withColumn("id", F.monotonically_increasing_id()), "vocabulary")


def near_pairs(vocabulary: DataFrame, limit: int = BATCH_BLOCKS) -> DataFrame:
    """(``id``, ``other``, ``other_word``, ``other_n``), both ways, for words one edit apart."""
    counts = {r["length"]: r["count"] for r in vocabulary.groupBy("length").count().collect()}
    if not counts:
        return vocabulary.select("id", F.col("id").alias("other"), F.col("word").alias("other_word"),
                                 F.col("n").alias("other_n")).limit(0)
    # Letters in use: bounded by the letters there are.
    signs = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = sorted(ord(r["c"]) for r in signs.collect())
    pairs = None
    for batch in plan_batches(counts, limit):
        some = candidate_pairs(vocabulary, alphabet, batch)
        pairs = some if pairs is None else pairs.unionByName(some)
    target = vocabulary.select("h", "length", F.col("id").alias("other"), F.col("word").alias("other_word"),
                               F.col("n").alias("other_n"))
    found = pairs.distinct().join(target, ["h", "length"]).drop("h", "length")
    source = vocabulary.select("id", "word", "n")
    close = materialize(found.join(source, "id").where(
        (F.col("id") != F.col("other")) & (F.levenshtein("word", "other_word", 1) == 1)), "near")
    back = close.select(F.col("other").alias("id"), F.col("id").alias("other"), F.col("word").alias("other_word"),
                        F.col("n").alias("other_n"))
    return close.select("id", "other", "other_word", "other_n").unionByName(back)


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 5, times: int = 5,
                    limit: int = BATCH_BLOCKS) -> DataFrame:
    """Every word of the vocabulary with its counts, its form and its root.

    The form is the near word of largest count (ties: the smallest word) if it occurs at
    least ``times`` as often; the root is where forms lead to, the word itself if it has
    none.  Columns ``word, form, root, n, n_near, form_n``; no rows for an empty table.
    """
    vocabulary = hashed_vocabulary(word_counts(docs, key, text, least))
    # A word has a bounded number of edits, and so of near words.
    best = near_pairs(vocabulary, limit).groupBy("id").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other_word", "other")).alias("best"))
    whole = vocabulary.select("id", "word", "n").join(best, "id", "left")
    strong = F.coalesce(-F.col("best.less") >= F.lit(times) * F.col("n"), F.lit(False))
    table = materialize(whole.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("to"), F.when(strong, F.col("best.other_word")).alias("form"),
        F.when(strong, -F.col("best.less")).alias("form_n")), "forms")
    ends = _followed(table.where("to is not null").select("id", "to"))
    names = vocabulary.select(F.col("id").alias("to"), F.col("word").alias("root"))
    rooted = ends.join(names, "to").select("id", "root")
    return table.join(rooted, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _followed(links: DataFrame) -> DataFrame:
    """Links (``id``, ``to``) led to the end of their chains, which halve each round; counts rise along
    a chain by a factor, so its length is a logarithm of the largest count."""
    now = materialize(links, "links")
    while True:
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("next"))
        joined = materialize(now.join(ahead, "to", "left"), "links")
        if joined.where("next is not null").isEmpty():
            return joined.select("id", "to")
        now = joined.select("id", F.coalesce("next", "to").alias("to"))
