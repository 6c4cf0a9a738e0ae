"""Flow file readers."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from netweave.plans.mapping import strip_names


def text_schema(columns: Sequence[str], text: Sequence[str]) -> StructType:
    """Strings for ``text`` columns, doubles for the rest."""
    return StructType([StructField(c, StringType() if c in text else DoubleType()) for c in columns])


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those paths (or patterns) that match at least one file."""
    return [p for p in paths if _problem(lambda p=p: spark.read.text(p)) is None]


def _problem(read: Callable[[], DataFrame]) -> str | None:
    """Why a file cannot be read, or None."""
    try:
        read()
    except (PySparkException, ValueError) as e:
        return str(e).splitlines()[0][:200]
    return None


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line of a file."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    return [c.strip() for c in first[0][0].split(",") if c.strip()]


def read_flows(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str | None = None,
               header: bool = True, names: Sequence[str] | None = None, columns: Sequence[str] | None = None,
               skip_missing: bool = True) -> DataFrame:
    """CSV files as one table, as :func:`read_flows_reported` reads them.

    Files that cannot be read are named in a warning; with ``skip_missing=False`` they raise.
    """
    df, skipped = read_flows_reported(spark, paths, schema, header, names, columns)
    if skipped and not skip_missing:
        raise FileNotFoundError(f"cannot read {skipped}")
    for path, reason in skipped.items():
        warnings.warn(f"skipped {path}: {reason}", stacklevel=2)
    return df


def read_flows_reported(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str | None = None,
                        header: bool = True, names: Sequence[str] | None = None,
                        columns: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """CSV files as one table, and the paths left out with the reason.

    ``schema`` avoids the extra pass of type inference and is what production jobs should
    pass; without it everything is read as text and coerced later.  Columns are found by
    their names in each path's header, stripped of blanks, whatever their order, and are
    null where a path lacks them; the files of one path must agree.  ``names`` replaces the
    header (or names the columns of headerless files), which then go by position.  Missing
    and unreadable paths, and those without a header, are left out, but one must remain.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("header", header).option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True)
    by_header: dict[tuple[str, ...], list[str]] = {}
    skipped: dict[str, str] = {}
    for p in paths:
        found: list[str] = []

        def look(p=p, found=found):
            plain = spark.read.option("header", header).csv(p)
            if not plain.columns:
                raise ValueError("it has no columns")
            found.extend(plain.columns)

        reason = _problem(look)
        if reason is None:
            by_position = not header or names is not None
            by_header.setdefault((str(len(found)),) if by_position else tuple(found), []).append(p)
        else:
            skipped[p] = reason
    if not by_header:
        raise FileNotFoundError(f"none of {paths} can be read: {skipped}")
    parts = []
    for head, group in by_header.items():
        if not header or names is not None:
            df = reader.schema(wanted).csv(group) if wanted is not None else reader.csv(group)
            parts.append(df.toDF(*names) if names is not None else df)
            continue
        if wanted is None:
            parts.append(strip_names(reader.csv(group)))
            continue
        # The header's own order, with the wanted types; the rest as text.
        kinds = {f.name: f.dataType for f in wanted}
        own = StructType([StructField(c, kinds.get(c.strip(), StringType())) for c in head])
        part = strip_names(reader.schema(own).csv(group))
        have = set(part.columns)
        parts.append(part.select(*[
            F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]))
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    return (df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df), skipped


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A parquet table, pruned to ``columns`` at the scan."""
    df = spark.read.parquet(path)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def try_read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where it cannot be read."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
