"""How filters interact: what each removes in every order, and its Shapley value.

A document's failures are one number, a bit for each filter.  For every coalition of filters
the removal game counts the documents that at least one of them removes; 32 sums per part of
the corpus say all there is to say about five filters.  Hart and Mas-Colell's potential of a
coalition S is ``(removed(S) + sum of the potentials of S without one member) / |S|``, and a
filter's Shapley value is the potential of all filters minus that without it.  Differences
between coalitions are what each step of each order removes.  The rows of a corpus are read
once; everything after their counts is arithmetic on one row per part.

Null texts count as empty, a null part as the empty string.  A null key fails no comparison
with another key, so such a row is nobody's copy and nobody is its copy.  Several rows of one
key are separate documents, none the copy of the other.  A key with several labels has each
of them.  An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Sequence
from hashlib import sha256
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.base import each_bytes, field, over_texts

#: Names of tests of a text, and what a text's bytes fail, in the order of the names.
Rules = tuple[str, Callable[[bytes], Sequence[bool]]]
#: Rows without a key are dealt over this many places when labels are joined.
_SPREAD = 256
_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(128, 192))
_SIGNS = re.compile(rb"[#$%&*|]")


def text_failures(text: bytes) -> tuple[bool, ...]:
    """Fixed rules that need only the text: too short, repetitive, loud, odd signs."""
    words = text.split()
    # Bytes that only continue a letter are left out, so what is left counts code points.
    letters = len(text.translate(None, _CONTINUED))
    loud = len(text) - len(text.translate(None, _UPPER))
    return (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * loud > 2 * letters,
            _SIGNS.search(text) is not None)


TEXT_RULES: Rules = ("ABCD", text_failures)


def with_copies(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Counts ``n`` of rows (``digest``, ``id`` and ``groups``) by digest, groups and whether a row
    of the same digest has a smaller id (``copy``).

    Rows are combined by digest and groups before they meet by digest, so one text copied a
    billion times is as many rows there as it has groups.
    """
    keys = ["digest", *groups]
    # Two numbers say how many rows are at the least id: the id, and the rows that hold it.
    at = rows.groupBy(*keys, "id").agg(F.count("*").alias("n"))
    some = at.groupBy(*keys).agg(
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
        F.sum("n").alias("all"), F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("unknown"))
    least = some.groupBy("digest").agg(F.min("first.id").alias("least"))
    both = some.join(least, "digest")
    originals = F.coalesce("unknown", F.lit(0)) + F.when(
        F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(
        F.struct(F.lit(False).alias("copy"), originals.alias("n")),
        F.struct(F.lit(True).alias("copy"), (F.col("all") - originals).alias("n"))))
    return both.select(*groups, split.alias("of")).select(*groups, "of.copy", "of.n").where("n > 0")


def coalition_counts(counts: DataFrame, filters: str) -> DataFrame:
    """One row per ``part``: ``rows``, and for each coalition (a number of filter bits, the place in the
    array) the rows ``removed`` and the ``good`` and ``toxic`` ones among them; ``only`` counts by single failure.

    ``counts`` holds ``part``, ``mask``, ``good``, ``toxic`` (booleans) and ``n``.
    """
    def game(admit: Column) -> Column:
        return F.array(*[F.sum(F.when((F.col("mask").bitwiseAND(s) != 0) & admit, F.col("n")).otherwise(0))
                         for s in range(1 << len(filters))])

    alone = F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(len(filters))])
    yes = F.lit(True)
    return counts.groupBy("part").agg(
        F.sum("n").alias("rows"), game(yes).alias("removed"), game(F.col("good")).alias("good"),
        game(F.col("toxic")).alias("toxic"), alone.alias("only"))


def with_potentials(games: DataFrame, filters: str, game: str = "removed") -> DataFrame:
    """Add ``potential``: for each coalition, n! times the potential of the game, a whole number."""
    n, whole = len(filters), factorial(len(filters))
    out = games.withColumn("_p0", F.lit(0).cast("long"))
    for size in range(1, n + 1):
        added = {}
        for members in itertools.combinations(range(n), size):
            s = sum(1 << i for i in members)
            total = F.lit(whole) * F.col(game)[s]
            for i in members:
                total = total + F.col(f"_p{s ^ 1 << i}")
            # n! / size! more divides the sum at this size, so nothing is lost.
            added[f"_p{s}"] = F.call_function("div", total, F.lit(size))
        out = out.withColumns(added)
    names = [f"_p{s}" for s in range(1 << n)]
    return out.withColumn("potential", F.array(*names)).drop(*names)


def order_steps(games: DataFrame, filters: str) -> DataFrame:
    """Every order of the filters and every step in it, with what the step does, per part."""
    n = len(filters)
    steps = []
    for order in itertools.permutations(range(n)):
        before = 0
        for place, i in enumerate(order):
            steps.append(("".join(filters[j] for j in order), place + 1, i, before))
            before |= 1 << i
    names = ("filter_order", "step", "_i", "_before")
    step = F.explode(F.arrays_zip(*[F.lit(list(c)).alias(a) for c, a in zip(zip(*steps), names)]))
    each = games.withColumn("_s", step).select("*", *[F.col(f"_s.{a}") for a in names])
    own = F.expr("shiftleft(1, _i)")
    after = F.col("_before").bitwiseOR(own)

    def change(game: str) -> Column:
        return F.get(F.col(game), after) - F.get(F.col(game), F.col("_before"))

    everything = (1 << n) - 1
    removed = change("removed")
    return each.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        (F.col("rows") - F.get(F.col("removed"), after)).alias("kept"), removed.alias("removed"),
        (F.get(F.col("removed"), own) - removed).alias("redundant"),
        F.get(F.col("only"), F.col("_i")).alias("unique_fails"),
        change("good").alias("good_lost"), change("toxic").alias("toxic_lost"),
        (F.col("potential")[everything] - F.get(F.col("potential"), F.lit(everything) - own)).alias("shapley"))


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id",
                   text: str = "text", rules: Rules = TEXT_RULES, copies: str | None = "E") -> tuple[DataFrame, str]:
    """Counts of documents by part, failures and labels, and the filters' names in the order of the bits.

    ``copies`` names the filter that a document fails whose text a smaller key has too, over
    the whole table; None leaves it out.
    """
    names, test = rules
    first = docs.select(field(docs, key).alias("id"), F.coalesce(field(docs, part).cast("string"), F.lit("")).alias("part"),
                        field(docs, text).alias("body"))

    def read(texts: pa.Array) -> list[pa.Array]:
        masks, digests = [], []
        for body in each_bytes(texts):
            masks.append(sum(1 << i for i, failed in enumerate(test(body)) if failed))
            digests.append(sha256(body).digest())
        return [pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]

    # Texts are read once; only their digests travel.
    rows = over_texts(first, "body", ["id", "part"], "mask int, digest binary", read)
    known = labels.select(field(labels, key).alias("id"), field(labels, "quality").alias("q"),
                          field(labels, "toxic").alias("t")).where("id is not null")
    marks = known.groupBy("id").agg(F.max((F.col("q") == 1).cast("int")).alias("q"), F.max((F.col("t") == 1).cast("int")).alias("t"))
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(_SPREAD))).otherwise(0).cast("int")
    marked = rows.withColumn("salt", salt).join(marks.withColumn("salt", F.lit(0)), ["id", "salt"], "left").select(
        "id", "part", "digest", "mask", F.coalesce(F.col("q") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("t") == 1, F.lit(False)).alias("toxic"))
    groups = ["part", "mask", "good", "toxic"]
    if copies is None:
        return marked.groupBy(*groups).agg(F.count("*").alias("n")), names
    counted = with_copies(marked, groups)
    mask = F.col("mask") + F.when(F.col("copy"), 1 << len(names)).otherwise(0)
    return counted.select("part", mask.cast("int").alias("mask"), "good", "toxic", "n").groupBy(*groups).agg(
        F.sum("n").alias("n")), names + copies


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id", text: str = "text",
                  rules: Rules = TEXT_RULES, copies: str | None = "E") -> DataFrame:
    """One row per part, order of the filters and step.

    ``kept`` documents are left after the step, ``removed`` go at it, ``redundant`` fail its
    filter but went before, ``unique_fails`` fail no other; ``good_lost`` and ``toxic_lost``
    are the removed ones with that label; ``shapley`` is the filter's removals over all
    orders: n! times its Shapley value.
    """
    counts, filters = failure_counts(docs, labels, part, key, text, rules, copies)
    return order_steps(with_potentials(coalition_counts(counts, filters), filters), filters)
