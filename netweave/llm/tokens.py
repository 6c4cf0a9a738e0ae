"""Token counts of whole texts by a public tokenizer, huge texts in overlapping chunks.

A text of more than ``chunk`` characters is cut into cores of that length.  Every core is
encoded by the tokenizer together with ``overlap`` characters on either side, with offsets.
Two neighbouring encodings are spliced at a boundary that both report and that is proven
stable: the character before it is one of the four plain white-space characters and the
token after it starts exactly there.  The tokenizer splits text at white space before it
merges, composes no character with white space and has no special token that holds any, so
no token reaches over such a place and nothing on one side changes the other.  All common
boundaries of a seam must also agree on the difference of the two token counts.  Where a
seam has none, or they disagree, the whole document is tried again with chunk and overlap
four times as large, in the end as one piece.  Chunks are rows, so one huge text is spread
over many tasks.

Shorter texts rest on the same proof with the chunk shrunk to a word: the words between
plain white space are encoded by the same tokenizer, each different word once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.base import TEXT, field, over_texts
from netweave.session import materialize

CHUNK = 32_768
OVERLAP = 256
#: Words remembered with their counts by one worker; forgotten together when there are more.
MEMO_WORDS = 300_000
#: Longer words are encoded each time.
MEMO_CHARS = 40
#: The white space of the proof; other kinds are left to the tokenizer.
PLAIN = " \t\n\r"


def word_vocabulary() -> str:
    """The file of the default vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file and the counts of words seen so far, once per worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = (Tokenizer.from_file(path), {})
    return _loaded[path]


def count_words(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, by the counts of its words."""
    coder, memo = tokenizer(path)
    words = [_words(t) for t in texts]
    seen = set().union(*words)
    new = list(seen - memo.keys())
    if len(memo) + len(new) > MEMO_WORDS:
        memo.clear()
        new = list(seen)
    memo.update(zip(new, map(len, coder.encode_batch_fast(new, add_special_tokens=False))))
    counts = [sum(map(memo.__getitem__, ws)) for ws in words]
    for w in new:
        if len(w) > MEMO_CHARS:
            del memo[w]
    return counts


def _words(text: str) -> list[str]:
    """The words between plain white space, without empty ones."""
    words = text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    return list(filter(None, words))


def boundaries(text: str, start: int, low: int, high: int, path: str) -> tuple[int, list[tuple[int, int]]]:
    """Encode a piece of a document that begins at character ``start``.

    Returns its number of tokens and the proven boundaries from ``low`` to ``high``, each as
    its place in the document and the number of the piece's tokens before it.
    """
    offsets = tokenizer(path)[0].encode(text, add_special_tokens=False).offsets
    found, before = [], 0
    for n, (a, b) in enumerate(offsets):
        # A token that starts where the last one ended, or before, starts no word.
        if a and low <= start + a <= high and a > before and text[a - 1] in PLAIN:
            found.append((start + a, n))
        before = max(before, b)
    return len(offsets), found


_PIECE = "part int, first long, last boolean, low1 long, high1 long, low2 long, high2 long, piece string"


def _pieces(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(``digest``, part, bounds, text) of every chunk of the documents (``digest``, text), copies once."""

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for part, core in enumerate(range(0, len(text), chunk)):
                    first, stop = max(0, core - overlap), min(len(text), core + chunk + overlap)
                    row = (digest, part, first, core + chunk >= len(text), core - overlap, core + overlap,
                           core + chunk - overlap, core + chunk + overlap, text[first:stop])
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    names = ["digest", "part", "first", "last", "low1", "high1", "low2", "high2", "piece"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.bool_()] + [pa.int64()] * 4 + [pa.string()]
    cuts = docs.select("digest", TEXT).mapInArrow(cut, f"digest string, {_PIECE}")
    rest = [c for c in names if c not in ("digest", "part")]
    one = cuts.groupBy("digest", "part").agg(F.first(F.struct(*rest)).alias("_row"))
    return one.select("digest", "part", *[F.col(f"_row.{c}").alias(c) for c in rest])


_SEAM = "array<struct<at:long,n:long>>"


def _encoded(pieces: DataFrame, path: str) -> DataFrame:
    seam = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, found = boundaries(row["piece"], row["first"], row["low1"], row["high2"], path)
                left = [{"at": p, "n": k} for p, k in found if p <= row["high1"]]
                right = [{"at": p, "n": k} for p, k in found if p >= row["low2"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["digest"]], pa.string()), pa.array([row["part"]], pa.int32()),
                     pa.array([row["last"]], pa.bool_()), pa.array([n], pa.int64()),
                     pa.array([left], seam), pa.array([right], seam)],
                    names=["digest", "part", "last", "n", "head", "tail"])

    return pieces.mapInArrow(run, f"digest string, part int, last boolean, n long, head {_SEAM}, tail {_SEAM}")


def _spliced(encoded: DataFrame) -> DataFrame:
    """(``digest``, ``n_tokens``, ``failed``) per document.

    Between the splices of its two seams a chunk contributes the difference of two of its own
    counts, so a document adds up to the last chunk's tokens and one difference per seam.
    """
    here = encoded.select("digest", "part", "last", "n", "tail")
    after = encoded.select("digest", (F.col("part") - 1).alias("part"), "head")
    shared = F.expr(
        "array_distinct(transform(filter(tail, x -> exists(head, y -> y.at = x.at)),"
        " x -> x.n - element_at(filter(head, y -> y.at = x.at), 1).n))")
    seams = here.join(after, ["digest", "part"], "left").withColumn("_shift", shared)
    good = F.col("last") | F.coalesce(F.size("_shift") == 1, F.lit(False))
    return seams.groupBy("digest").agg(
        F.sum(F.when(F.col("last"), F.col("n")).otherwise(F.try_element_at("_shift", F.lit(1)))).alias("n_tokens"),
        F.max(~good).alias("failed"))


def long_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(``digest``, ``n_tokens``) of the documents (``digest``, text), by overlap resynchronisation."""
    done = None
    while True:
        # Written, since a seam reads the chunks on both its sides.
        encoded = materialize(_encoded(_pieces(docs, chunk, overlap), path), "token-pieces")
        counts = materialize(_spliced(encoded), "token-counts")
        good = counts.where(~F.col("failed")).select("digest", "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = counts.where("failed").select("digest")
        if failed.isEmpty():
            return done
        docs = docs.join(failed, "digest", "left_semi")
        chunk, overlap = 4 * chunk, 4 * overlap


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
                 limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(``key``, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    ``vocabulary`` is the path of a tokenizer file that every executor can open.  Null and
    empty texts have no bytes and no tokens.  A key may repeat; other columns do not matter.
    """
    path = vocabulary or word_vocabulary()
    body = F.coalesce(field(docs, text).cast("string"), F.lit(""))
    rows = docs.select(field(docs, key).alias(key), body.alias(TEXT))

    def count(texts: pa.Array):
        return [pa.array(count_words(texts.to_pylist(), path), pa.int64())]

    short = rows.where(F.length(TEXT) <= chunk).withColumn("_bytes", F.octet_length(TEXT).cast("long"))
    short = over_texts(short, TEXT, [key, "_bytes"], "n_tokens long", count)
    long = rows.where(F.length(TEXT) > chunk).withColumn("digest", F.sha2(TEXT, 256))
    sized = long.select(field(long, key), F.octet_length(TEXT).cast("long").alias("_bytes"), "digest")
    spliced = sized.join(long_counts(long, path, chunk, overlap), "digest").select(key, "_bytes", "n_tokens")
    both = short.unionByName(spliced)
    return both.select(field(both, key), F.col("_bytes").alias("n_bytes"), "n_tokens",
                       (F.col("n_tokens") > limit).alias("over_limit"))
