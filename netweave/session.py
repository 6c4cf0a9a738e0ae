"""Session helpers: a local builder for tests and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def local_session(app: str = "netweave", cores: str = "*", shuffle_partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def working_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Uses ``spark.checkpoint.dir`` or the context's checkpoint directory.  Only a
    local master may fall back to a temporary folder, since executors on other
    machines could not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="netweave-"))
    return context.getCheckpointDir().rstrip("/")


_written: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the working folder, which :func:`release` will remove."""
    path = f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def release(spark: SparkSession, keep: Sequence[str] = ()) -> int:
    """Remove the intermediate tables that this process has written, but for those in ``keep``.

    For a caller who has stored what it wants: results that were not written yet still read
    them.  Returns how many were removed.
    """
    gone = [p for p in sorted(_written) if p not in set(keep)]
    for path in gone:
        discard(spark, path)
    return len(gone)


def discard(spark: SparkSession, path: str | None) -> None:
    """Remove one intermediate table that nothing will read again."""
    if path is not None:
        context = spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        _written.discard(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the working folder and read it back.

    Cuts the lineage, survives the loss of executors, freezes anything that
    depends on task placement, and gives the planner real sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class Stored:
    """A table that was written to the working folder."""

    path: str
    schema: StructType


@contextmanager
def discarding(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], Stored]]:
    """Remove what is written inside the block, but for what the given function stores."""
    before, kept = set(_written), set()

    def keep(df: DataFrame, name: str) -> Stored:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        kept.add(path)
        return Stored(path, df.schema)

    yield keep
    for path in sorted(_written - before - kept):
        discard(spark, path)


def small_table(spark: SparkSession, rows: Sequence[Sequence], ddl: str) -> DataFrame:
    """A driver-side table as a local relation, whose size the planner knows."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    table = pa.table({
        f.name: pa.array(list(values), to_arrow_type(f.dataType)) for f, values in zip(schema, columns)
    })
    return spark.createDataFrame(table, schema)
