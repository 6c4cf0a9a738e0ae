"""Benchmark passages in documents, by one Aho-Corasick automaton over the normalised items.

A window is ``size`` consecutive words of an item, or all of them if it has fewer.  The
windows of all items are the patterns of an automaton, which reads each document's
normalised words once; a match gives the windows that end there, and its place is mapped
back through the word starts to the words and the characters of the original.  Documents
never move.  Should the windows outgrow ``shard_bytes``, they are dealt to several automata,
each broadcast by itself, and the hits of a document are put together afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.base import each_bytes, field, over_texts
from netweave.llm.words import fold
from netweave.session import materialize

SIZE = 10
#: Most bytes of windows and item ids in one broadcast automaton.
SHARD_BYTES = 32 << 20

_WORD = re.compile(rb"[^ ]+")


def benchmark_windows(items: DataFrame, size: int = SIZE, key: str = "item_id", text: str = "text") -> DataFrame:
    """(``window``, ``item``): every different window of every item, the item's id as text.

    Null and empty items have none; items without an id have windows that count for no item.
    """

    def cut(texts: pa.Array):
        out = []
        for t in each_bytes(texts):
            words = fold(t).split()
            out.append([b" ".join(words[i:i + size]).decode()
                        for i in range(max(1, len(words) - size + 1))] if words else [])
        return [pa.array(out, pa.list_(pa.string()))]

    rows = items.select(field(items, key).cast("string").alias("item"), field(items, text).alias("_body"))
    return over_texts(rows, "_body", ["item"], "windows array<string>", cut).select(
        F.explode("windows").alias("window"), "item").distinct()


class Matcher:
    """The automaton of some windows."""

    def __init__(self, windows: dict[str, list[str]]):
        self.items = list(windows.values())
        self.lengths = [w.count(" ") + 1 for w in windows]
        self.machine = ahocorasick.Automaton()
        for n, w in enumerate(windows):
            self.machine.add_word(f" {w} ", n)
        if windows:
            self.machine.make_automaton()

    def match(self, text: bytes) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """Number of words; hit stretches as (first word, last word, start, end in characters); items met."""
        folded = fold(text)
        words = folded.split()
        if not words or not self.items:
            return len(words), [], []
        line = f" {b' '.join(words).decode()} "
        found = list(self.machine.iter(line))
        if not found:
            return len(words), [], []
        gaps = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
        last = np.searchsorted(gaps, [end for end, _ in found]) - 1
        which = [n for _, n in found]
        first = last - np.array([self.lengths[n] for n in which]) + 1
        spans = [m.span() for m in _WORD.finditer(folded)]
        hits = []
        for a, b in merged(zip(first.tolist(), last.tolist())):
            start, end = spans[a][0], spans[b][1]
            lead = len(text[:start].decode())
            hits.append((a, b, lead, lead + len(text[start:end].decode())))
        items = sorted(set().union(*[self.items[n] for n in set(which)]))
        return len(words), hits, items


def merged(stretches) -> list[tuple[int, int]]:
    """Inclusive stretches united where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_RESULT = ("n_words long, hits array<struct<first:long,last:long,start:long,end:long>>, items array<string>")


def _scan(docs: DataFrame, keep: Sequence[str], text: str, windows: list) -> DataFrame:
    """One automaton over all documents; ``windows``: rows of a bounded shard."""
    table: dict[str, list[str]] = {}
    for w, item in sorted((r["window"], r["item"]) for r in windows if r["item"] is not None):
        table.setdefault(w, []).append(item)
    for r in windows:
        table.setdefault(r["window"], [])
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(texts: pa.Array, matcher: Matcher):
        rows = [matcher.match(t) for t in each_bytes(texts)]
        hits = [[dict(zip(("first", "last", "start", "end"), h)) for h in r[1]] for r in rows]
        return [pa.array([r[0] for r in rows], pa.int64()), pa.array(hits, _HITS),
                pa.array([r[2] for r in rows], pa.list_(pa.string()))]

    return over_texts(docs, text, keep, _RESULT, run, lambda: Matcher(shared.value))


def contamination(docs: DataFrame, items: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
                  size: int = SIZE, item_key: str = "item_id", item_text: str = "text",
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The kept columns, ``n_words``, ``hits`` (stretches of hit words) and ``items`` (sorted ids as text).

    Null and empty documents have no words; an empty benchmark hits nothing.
    """
    keep = list(keep)
    windows = materialize(benchmark_windows(items, size, item_key, item_text), "windows")
    weight = F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16
    total = windows.agg(F.sum(weight).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_bytes))
    if shards == 1:
        return _scan(docs, keep, text, windows.collect())
    rows = materialize(docs.select(*[field(docs, k) for k in keep], field(docs, text).alias("_body"))
                       .withColumn("_row", F.monotonically_increasing_id()), "documents")
    dealt = windows.withColumn("_shard", F.pmod(F.xxhash64("window"), F.lit(shards)))
    parts = None
    for k in range(shards):
        part = _scan(rows, ["_row"], "_body", dealt.where(F.col("_shard") == k).collect())
        parts = part if parts is None else parts.unionByName(part)
    spread = materialize(parts, "hits")
    # A document has at most as many stretches as words in each shard.
    met = spread.groupBy("_row").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def unite(batches):
        for batch in batches:
            out = []
            for hits in batch.column(1).to_pylist():
                starts = {h["first"]: h["start"] for h in hits}
                ends = {h["last"]: h["end"] for h in hits}
                out.append([{"first": a, "last": b, "start": starts[a], "end": ends[b]}
                            for a, b in merged((h["first"], h["last"]) for h in hits)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _HITS)], names=["_row", "hits"])

    joined = met.select("_row", "_hits").mapInArrow(
        unite, "_row long, hits array<struct<first:long,last:long,start:long,end:long>>")
    result = rows.drop("_body").join(met.drop("_hits"), "_row").join(joined, "_row")
    return result.select(*[field(result, k) for k in keep], "n_words", "hits", "items")
