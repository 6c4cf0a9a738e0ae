"""Exact quantiles without gathering a column in one place.

Small columns use the built-in ``percentile``, whose buffer maps every distinct value to its
count.  Beyond ``small`` cells that buffer is no longer bounded, so the order statistics are
narrowed down instead: doubles become whole numbers of the same order, and every pass counts,
for all ranks at once, how many values fall into each piece of the ranges still possible.
A pass cuts a range by its number of pieces, so the 64 bits of a double are used up after a
few, whatever the values are; ranges with few values end sooner, value by value.

Nulls and undefined values (NaN) are left out; infinite ones are the least and the largest.
Both ways give the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.plans.mapping import column
from netweave.session import materialize

SMALL = 1_000_000  # cells (rows x columns) whose distinct values may share one buffer
#: Pieces of a column's ranges together, in one pass, and pieces of a range at least.
_PIECES, _LEAST = 4_096, 16
#: Rows of a column's ranges that are told value by value, together, in one pass.
_FEW = 32_768
_SKETCH = 10_000


@dataclass
class _Range:
    """Keys that can still hold some ranks; ranks count from the first key of the range."""

    col: int
    low: int
    high: int
    rows: int
    ranks: dict[int, int]  # rank in the column -> rank in the range

    def shift(self, pieces: int) -> int:
        return max(0, (self.high - self.low).bit_length() - (pieces.bit_length() - 1))


def finite_or_ordered(c: str) -> Column:
    """The column as a double, undefined values as null, negative zero as zero."""
    v = column(c).cast("double")
    return F.when(~F.isnan(v), v + F.lit(0.0))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], exact: bool = True,
              small: int = SMALL) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column, nulls and undefined values ignored.

    ``exact=False`` returns a sketch's answer after one pass.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    if not cols or not probs:
        return {c: [] for c in cols}
    values = [finite_or_ordered(c).alias(f"v{i}") for i, c in enumerate(cols)]
    if not exact:
        row = df.select(*values).agg(*[F.percentile_approx(f"v{i}", probs, _SKETCH).alias(f"q{i}") for i in range(len(cols))])
        first = row.first()
        return {c: list(first[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(cols)}
    counts = df.select(*values).agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(cols))]).first()
    if sum(counts) <= small:
        wanted = F.expr("array(" + ",".join(f"{p!r}D" for p in probs) + ")")
        row = df.select(*values).agg(*[F.percentile(f"v{i}", wanted).alias(f"q{i}") for i in range(len(cols))]).first()
        return {c: list(row[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(cols)}
    # The passes read a narrow table, not the plan behind it again.
    table = materialize(df.select(*values), "quantile-values")
    places = {i: [p * (n - 1) for p in probs] for i, n in enumerate(counts) if n}
    ranks = {i: sorted({r for x in xs for r in (math.floor(x), math.ceil(x))}) for i, xs in places.items()}
    found = order_statistics(table, ranks)
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for i, xs in places.items():
        out[cols[i]] = [_between(found[i, math.floor(x)], found[i, math.ceil(x)], x) for x in xs]
    return out


def _between(low: float, high: float, at: float) -> float:
    if low == high:
        return low
    return (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def order_statistics(table: DataFrame, ranks: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """The values at zero-based ranks of the columns ``v0``, ``v1``, ... without undefined values."""
    wanted = sorted(ranks)
    if not wanted:
        return {}
    ends = table.agg(*[f(f"v{i}").alias(f"{n}{i}") for i in wanted for n, f in (("a", F.min), ("b", F.max), ("n", F.count))]).first()
    active = [_Range(i, _key(ends[f"a{i}"]), _key(ends[f"b{i}"]), ends[f"n{i}"], {r: r for r in ranks[i]}) for i in wanted]
    found: dict[tuple[int, int], float] = {}
    while True:
        for r in active:
            if r.low == r.high:
                found.update(((r.col, k), _value(r.low)) for k in r.ranks)
        active = [r for r in active if r.low < r.high]
        if not active:
            return found
        active = _narrowed(table, active)


def _narrowed(table: DataFrame, active: list[_Range]) -> list[_Range]:
    """One pass over the values: every range becomes the pieces of it that hold its ranks."""
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, r in enumerate(active):
        ranges = sum(x.col == r.col for x in active)
        told = r.rows * ranges <= _FEW
        plan.setdefault(r.col, []).append((r.low, r.high, 0 if told else r.shift(max(_LEAST, _PIECES // ranges)), n))
    for ranges in plan.values():
        ranges.sort()
    counted = table.select(*[f"v{i}" for i in plan]).mapInArrow(_counter(plan), "range int, piece decimal(20,0), n long")
    pieces: dict[int, list[tuple[int, int]]] = {}
    for row in counted.groupBy("range", "piece").agg(F.sum("n").alias("n")).collect():
        pieces.setdefault(row["range"], []).append((int(row["piece"]), row["n"]))
    out = []
    for i, ranges in plan.items():
        for low, high, shift, n in ranges:
            before, waiting = 0, sorted(active[n].ranks.items(), key=lambda x: x[1])
            for piece, rows in sorted(pieces[n]):
                held = {k: at - before for k, at in waiting if before <= at < before + rows}
                if held:
                    first = low + (piece << shift)
                    out.append(_Range(i, first, min(high, first + (1 << shift) - 1), rows, held))
                before += rows
    return out


def _counter(plan: dict[int, list[tuple[int, int, int, int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            for at, ranges in enumerate(plan.values()):
                keys = _keys(batch.column(at).drop_null().to_numpy(zero_copy_only=False))
                lows = np.array([r[0] for r in ranges], np.uint64)
                which = np.searchsorted(lows, keys, "right") - 1
                highs, shifts = (np.array([r[k] for r in ranges], np.uint64) for k in (1, 2))
                keys, which = keys[which >= 0], which[which >= 0]
                inside = keys <= highs[which]
                keys, which = keys[inside], which[inside]
                piece = (keys - lows[which]) >> shifts[which]
                order = np.lexsort((piece, which))
                which, piece = which[order], piece[order]
                starts = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (piece[1:] != piece[:-1])]) if len(which) else []
                for a, n in zip(starts, np.diff(np.r_[starts, len(which)]) if len(which) else []):
                    cell = ranges[int(which[a])][3], int(piece[a])
                    sums[cell] = sums.get(cell, 0) + int(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[0] for c in sums], pa.int32()), pa.array([c[1] for c in sums], pa.decimal128(20, 0)),
             pa.array(list(sums.values()), pa.int64())], names=["range", "piece", "n"])

    return run


_SIGN = np.uint64(1 << 63)


def _keys(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned whole numbers in the same order."""
    bits = np.ascontiguousarray(x, np.float64).view(np.uint64)
    return np.where(bits & _SIGN != 0, ~bits, bits | _SIGN)


def _key(x: float) -> int:
    return int(_keys(np.array([x]))[0])


def _value(key: int) -> float:
    bits = np.uint64(key)
    return float(np.array([bits ^ _SIGN if bits & _SIGN else ~bits], np.uint64).view(np.float64)[0])
