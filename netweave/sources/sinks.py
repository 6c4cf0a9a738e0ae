"""Writers.  None of them overwrites unless told to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header line per part file."""
    df.write.option("header", True).mode(mode).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet, optionally partitioned by low-cardinality columns such as the class or split."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(sheets: Mapping[str, DataFrame], path: str, form: str = "parquet", mode: str = "errorifexists") -> list[str]:
    """One table per sheet below ``path``; returns the written paths."""
    out = []
    for name, df in sheets.items():
        target = f"{path}/{name.strip().lower().replace(' ', '_')}"
        if form == "csv":
            write_csv(df, target, mode)
        else:
            write_table(df, target, mode=mode)
        out.append(target)
    return out
