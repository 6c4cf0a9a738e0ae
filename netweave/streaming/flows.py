"""Structured streaming over flows and packets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.operators.features import FlowPreprocessorModel
from netweave.operators.flows import KEY, flow_columns, flow_key, flow_measures
from netweave.session import scratch_path


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream the files of a parquet table; later files become later batches.

    A table that is one file is streamed from its folder by name.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(location).isFile():
        return reader.option("pathGlobFilter", location.getName()).parquet(location.getParent().toString())
    return reader.parquet(path)


def score_stream(flows: DataFrame, prep: FlowPreprocessorModel, keep: list[str],
                 scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Apply frozen preprocessing (and a model) to a stream.  Stateless: literals and static lookups only."""
    out = prep.transform(flows, keep)
    return scorer(out) if scorer else out


def session_flows(packets: DataFrame, gap: str = "10 minutes", watermark: str = "10 minutes",
                  split_directions: bool = True) -> DataFrame:
    """Flows that close after ``gap`` without a packet in either direction.

    Works on batch and streaming packets alike.  In a stream a flow is emitted once
    the watermark passes its end, and packets later than the watermark are dropped,
    so state stays bounded by the traffic of one watermark span.
    """
    keyed = flow_key(packets.withColumn("ts", F.col("ts").cast("timestamp")))
    if keyed.isStreaming:
        keyed = keyed.withWatermark("ts", watermark)
    sums = keyed.groupBy(F.session_window("ts", gap).alias("session"), *KEY).agg(*flow_measures())
    keys = [*KEY, F.col("session.start").alias("session_start")]
    return flow_columns(sums, keys, split_directions)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drain what a stream has so far into a table in the working folder and read it."""
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
