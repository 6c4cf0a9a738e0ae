"""Packets to bidirectional flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.plans.schemas import NB15_COLUMNS

END = ("ip", "port")


def endpoints() -> tuple[Column, Column]:
    """The packet's two (address, port) ends, and their order within a flow key."""
    source = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    target = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    return source, target


def flow_key(packets: DataFrame) -> DataFrame:
    """Packets with an address, the canonical 5-tuple as ``a_*``/``b_*``, and ``forward``.

    The end that sorts first is side a, so both directions share a key.
    """
    source, target = endpoints()
    known = packets.where(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()).fillna(
        "0", subset=["src_port", "dst_port"])
    return known.withColumns({"_a": F.least(source, target), "_b": F.greatest(source, target)}).withColumns({
        "a_ip": F.col("_a.ip"), "a_port": F.col("_a.port"), "b_ip": F.col("_b.ip"), "b_port": F.col("_b.port"),
        "forward": source == F.col("_a"),
    }).drop("_a", "_b")


KEY = ("a_ip", "a_port", "b_ip", "b_port", "proto")


def seconds(start: Column, end: Column) -> Column:
    """Elapsed seconds with microseconds."""
    def micros(c):
        return F.unix_micros(c.cast("timestamp"))

    return (micros(end) - micros(start)) / F.lit(1e6)


def flow_measures() -> list[Column]:
    """Partial sums that combine map-side, so a flow of any size is cheap."""
    length = F.col("length").cast("long")
    ahead = F.col("forward")
    return [
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count("*").alias("packets"), F.sum(length).alias("bytes"),
        F.count_if(ahead).alias("fwd_packets"),
        F.sum(F.when(ahead, length).otherwise(F.lit(0))).alias("fwd_bytes"),
    ]


def flow_columns(sums: DataFrame, keys, split_directions: bool = True) -> DataFrame:
    """Flow features from the sums of :func:`flow_measures`.

    Without ``split_directions`` both sides carry the flow's totals.
    """
    dur = seconds(F.col("first_ts"), F.col("last_ts"))
    packets, size = F.col("packets"), F.col("bytes")
    if split_directions:
        spkts, sbytes = F.col("fwd_packets"), F.col("fwd_bytes")
        dpkts, dbytes = packets - spkts, size - sbytes
    else:
        spkts, sbytes, dpkts, dbytes = packets, size, packets, size

    def mean(total, n):
        return F.coalesce(F.try_divide(total.cast("double"), n.cast("double")), F.lit(0.0))

    return sums.select(
        *keys, dur.alias("dur"), spkts.alias("spkts"), dpkts.alias("dpkts"), sbytes.alias("sbytes"),
        dbytes.alias("dbytes"), F.when(dur > 0, size / dur).otherwise(F.lit(0.0)).alias("rate"),
        mean(sbytes, spkts).alias("smean"), mean(dbytes, dpkts).alias("dmean"),
    )


def assemble_flows(packets: DataFrame, split_directions: bool = True) -> DataFrame:
    """One row per bidirectional 5-tuple of a whole capture.

    ``packets``: ts, length, src_ip, src_port, dst_ip, dst_port, proto.
    """
    sums = flow_key(packets).groupBy(*KEY).agg(*flow_measures())
    return flow_columns(sums, KEY, split_directions)


def to_nb15(flows: DataFrame) -> DataFrame:
    """Assembled flows in the NB15 layout; what packets cannot tell is neutral."""
    have = set(flows.columns)
    fixed = {"service": F.lit("-"), "state": F.lit("-"), "attack_cat": F.lit("Normal")}
    return flows.select(*[
        F.col(c) if c in have else fixed.get(c, F.lit(0)).alias(c) for c in NB15_COLUMNS if c != "id"
    ])
