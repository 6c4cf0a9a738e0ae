"""Shared plumbing of the text operators: Arrow batches in, Arrow batches out.

Conventions that hold for every operator built on these helpers:

* a null text counts as the empty text, whatever the other columns hold;
* only the columns named by the caller travel; any others, whatever their names, are left behind;
* repeated rows are separate rows and get the same result each;
* an empty table gives an empty result with the full schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

TEXT = "_text"
#: Rows of one Arrow batch are worked through in slices of about this many bytes of text.
SLICE_BYTES = 4 << 20


def field(df: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def over_texts(df: DataFrame, text: str, keep: Sequence[str], result: str,
               fn: Callable[[pa.Array], Sequence[pa.Array]], setup: Callable[[], object] | None = None) -> DataFrame:
    """Add columns computed from ``text`` by ``fn`` to the columns in ``keep``.

    ``fn`` gets a string array without nulls (and the value of ``setup``, made once per
    task, if given) and returns one array for each field of the DDL in ``result``.  Long
    batches reach it in slices, so its working memory does not follow the batch size.
    """
    added = StructType.fromDDL(result)
    clash = set(keep) & set(added.names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are both kept and computed")
    # Names of their own inside, so that any name may be kept, also twice or with dots.
    names = [f"_k{i}" for i in range(len(keep))]
    schema = StructType([StructField(n, df.schema[k].dataType) for n, k in zip(names, keep)] + list(added))
    narrow = df.select(*[field(df, k).alias(n) for n, k in zip(names, keep)],
                       F.coalesce(field(df, text).cast("string"), F.lit("")).alias(TEXT))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            for part in slices(batch):
                made = fn(part.column(len(keep)), *state)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=schema.names)

    return narrow.mapInArrow(run, schema).toDF(*keep, *added.names)


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch whose last column is text, about ``size`` bytes of it at a time."""
    ends = text_buffers(batch.columns[-1])[1][1:]
    done = 0
    while done < batch.num_rows:
        start = int(ends[done - 1]) if done else int(text_buffers(batch.columns[-1])[1][0])
        stop = max(int(np.searchsorted(ends, start + size, "right")), done + 1)
        yield batch.slice(done, stop - done)
        done = stop


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes behind a string array, and the offsets of its rows in them (one more than rows)."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def each_bytes(texts: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of every row."""
    raw, at = text_buffers(texts)
    whole = memoryview(raw)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield bytes(whole[a:b])


def label_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, max_chars: int,
                 key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """A bounded, repeatable sample of labelled documents, and the counts of the two classes.

    Takes, of the rows of ``labels`` that ``keep`` admits, at most ``per_class`` keys of each
    class (0 and 1) in the order of a hash of the key, and of these the documents of at most
    ``max_chars`` characters.  Keys with both labels or none are left out.  One row
    (``_key``, ``_label``, ``_text``) per key; a key of several documents gets the least text.
    """
    y = field(labels, label)
    clean = (
        labels.where(keep & y.isin(0, 1) & field(labels, key).isNotNull())
        .groupBy(field(labels, key).alias("_key")).agg(F.min(y).alias("_label"), F.max(y).alias("_most"))
        .where(F.col("_label") == F.col("_most")).drop("_most")
    )
    counts = {int(r["_label"]): r["n"] for r in clean.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    order = [F.md5(F.col("_key").cast("string").cast("binary")), F.col("_key")]
    chosen = None
    for value in (0, 1):
        part = clean.where(F.col("_label") == value).orderBy(*order).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class keys.
    body = F.coalesce(field(docs, text), F.lit(""))
    found = docs.select(field(docs, key).alias("_key"), body.alias(TEXT)).where(F.length(TEXT) <= max_chars)
    sample = found.join(F.broadcast(chosen), "_key").groupBy("_key", "_label").agg(F.min(TEXT).alias(TEXT))
    return sample, counts


def crc_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo ``buckets``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(buckets))
