"""Declarative schema conformance.

A :class:`MappingSpec` lists target columns with the source names they may come
from.  Name resolution happens once against ``df.columns``; the rows then pass
through a single ``select``, so a conversion of any size has no shuffle and
reads only the source columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.functions.numeric import coerce_double

KEEP = object()  # Target.fill value that leaves nulls in place


def column(name: str) -> Column:
    """A column by its literal name, whatever spaces, dots or slashes it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Target:
    """One output column.

    ``sources`` are tried in order.  With ``pick="first"`` the first name present
    wins, with ``pick="last"`` the last one.  ``kind`` is ``number`` (text is
    coerced, bad or missing values become ``fill``), ``text`` or ``raw``.  ``fill``
    is the default unless given; :data:`KEEP` leaves nulls.
    ``make`` turns the source column into the value.
    """

    name: str
    sources: tuple[str, ...] = ()
    default: object = 0
    kind: str = "number"
    fill: object = None
    pick: str = "first"
    make: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class MappingSpec:
    """A named conversion.

    ``derived`` columns are computed from the mapped ones and replace them.
    ``keep_rest`` passes unmapped source columns through; ``present_only`` drops
    targets that no source column provides.  ``label`` names the source label and
    ``known_labels`` the values its mapping covers.
    """

    name: str
    targets: tuple[Target, ...]
    derived: tuple[tuple[str, Callable[[], Column]], ...] = ()
    keep_rest: bool = False
    present_only: bool = False
    label: str | None = None
    known_labels: frozenset[str] | None = None
    order: tuple[str, ...] = field(default=())
    sequence: str | None = None


def first_present(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """The first of ``names`` that is a column."""
    have = set(columns)
    return next((n for n in names if n in have), None)


def _resolve(columns: Sequence[str], target: Target) -> str | None:
    names = target.sources if target.pick == "first" else tuple(reversed(target.sources))
    return first_present(columns, names)


def _value(df: DataFrame, target: Target) -> Column:
    source = _resolve(df.columns, target)
    if source is None:
        value = F.lit(target.default)
        return value.cast("double") if target.kind == "number" else value
    value = column(source)
    if target.make is not None:
        return target.make(value)
    if target.kind == "number":
        value = coerce_double(value, is_text=dict(df.dtypes)[source] == "string")
    elif target.kind == "text":
        value = value.cast("string")
    if target.kind == "raw" or target.fill is KEEP:
        return value
    fill = target.default if target.fill is None else target.fill
    return F.coalesce(value, F.lit(float(fill) if target.kind == "number" else str(fill)))


def strip_names(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks."""
    return df.toDF(*[c.strip() for c in df.columns])


def unmapped_labels(df: DataFrame, spec: MappingSpec) -> DataFrame:
    """Label values outside the spec's vocabulary with their row counts."""
    if spec.label is None or spec.known_labels is None:
        raise ValueError(f"{spec.name} has no closed label vocabulary")
    label = column(spec.label).cast("string")
    return (
        strip_names(df)
        .where(label.isNull() | ~label.isin(*sorted(spec.known_labels)))
        .groupBy(label.alias("label")).agg(F.count("*").alias("rows"))
    )


def conform(df: DataFrame, spec: MappingSpec, unmapped: str = "default") -> DataFrame:
    """Project ``df`` onto the spec's target layout.

    ``unmapped="strict"`` raises when a label falls outside the vocabulary, which
    the default mapping would turn into its default class.
    """
    df = strip_names(df)
    if unmapped == "strict":
        stray = unmapped_labels(df, spec).orderBy(F.desc("rows")).first()
        if stray is not None:
            raise ValueError(f"{spec.name}: unmapped label {stray['label']!r} on {stray['rows']} rows")
    targets = spec.targets
    if spec.present_only:
        targets = tuple(t for t in targets if _resolve(df.columns, t) is not None)
    chosen = [_value(df, t).alias(t.name) for t in targets]
    if spec.keep_rest:
        used = {s for t in targets for s in t.sources}
        names = {t.name for t in targets}
        chosen += [column(c) for c in df.columns if c not in used and c not in names]
    out = df.select(*chosen)
    if spec.derived:
        # All derivations see the mapped values, so one projection suffices.
        extra = {name: make() for name, make in spec.derived}
        kept = [extra.pop(c).alias(c) if c in extra else column(c) for c in out.columns]
        out = out.select(*kept, *[v.alias(n) for n, v in extra.items()])
    if spec.order:
        out = out.select(*[column(c) for c in spec.order])
    return out


def align(df: DataFrame, columns: Sequence[str], default=0) -> DataFrame:
    """Exactly ``columns`` in that order, absent ones filled with ``default``."""
    have = set(df.columns)
    return df.select(*[column(c) if c in have else F.lit(default).alias(c) for c in columns])


def rename_present(df: DataFrame, names: dict[str, str], only: bool = False) -> DataFrame:
    """Rename by dictionary; ``only`` keeps nothing but the renamed columns."""
    if only:
        have = set(df.columns)
        return df.select(*[column(s).alias(t) for s, t in names.items() if s in have])
    return df.withColumnsRenamed(names)


def drop_present(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)
