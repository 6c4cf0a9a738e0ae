"""Views shared by the registered queries, in Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.functions.hashing import stream_constants, unit_hash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when given, the SQL that must agree with it."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*[
        F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes
    ])


# --- flows over events -----------------------------------------------------------

NUMERIC = ["duration", "src_bytes", "dst_bytes", "same_srv_rate"]
TEXT = ["protocol_type", "flag"]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six model columns, a key and a label, from ``events``."""
    e = table(spark, sf_dir, "events")
    hour, value = F.hour("ts"), F.col("value")
    raised = value + F.when(F.col("event_type") == "error", 40).otherwise(0)
    return e.select(
        F.col("event_id").alias("row_id"), "ts", "user_id",
        (F.minute("ts") * 60 + F.second("ts")).cast("double").alias("duration"),
        value.alias("src_bytes"), (value * value / 10).alias("dst_bytes"),
        (F.get_json_object("props", "$.k").try_cast("double") / 100).alias("same_srv_rate"),
        F.col("event_type").alias("protocol_type"),
        F.when(hour < 8, "SF").when(hour < 16, "S0").otherwise("REJ").alias("flag"),
        F.when(raised <= 80, "normal").when(F.col("event_type").isin("error", "click"), "neptune")
        .otherwise("satan").alias("labels"),
    )


FLOWS = """flows AS (
  SELECT event_id AS row_id, ts, user_id,
    CAST(extract(minute FROM ts) * 60 + extract(second FROM ts) AS DOUBLE) AS duration,
    value AS src_bytes, value * value / 10 AS dst_bytes,
    CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE) / 100 AS same_srv_rate,
    event_type AS protocol_type,
    CASE WHEN extract(hour FROM ts) < 8 THEN 'SF' WHEN extract(hour FROM ts) < 16 THEN 'S0' ELSE 'REJ' END AS flag,
    CASE WHEN value + CASE WHEN event_type = 'error' THEN 40 ELSE 0 END <= 80 THEN 'normal'
         WHEN event_type IN ('error', 'click') THEN 'neptune' ELSE 'satan' END AS labels
  FROM events)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with a 0/1 label."""
    return flows(spark, sf_dir).withColumn("label", (F.col("labels") != "normal").cast("int"))


LABELLED = FLOWS + """, labelled AS (
  SELECT *, CAST(labels <> 'normal' AS INTEGER) AS label FROM flows)"""


# --- key hashes --------------------------------------------------------------------

def hash_sql(key: str = "row_id", seed: int = 42) -> str:
    """60-bit key hash."""
    return f"CAST('0x' || substr(md5('{seed}|' || {key}), 1, 15) AS BIGINT)"


def unit_sql(key: str = "row_id", seed: int = 42) -> str:
    return f"({hash_sql(key, seed)} / CAST(1152921504606846976 AS DOUBLE))"


def words_sql(key: str = "row_id", seed: int = 42) -> str:
    """The two 28-bit words as columns ``wa`` and ``wb``."""
    text = f"md5('{seed}|' || {key})"
    return f"CAST('0x' || substr({text}, 1, 7) AS BIGINT) AS wa, CAST('0x' || substr({text}, 8, 7) AS BIGINT) AS wb"


def mix_sql(stream: str) -> str:
    """A named uniform draw from ``wa`` and ``wb``."""
    a, b, c = stream_constants(stream)
    return f"(((wa * {a} + wb * {b} + {c}) % 2147483647 + CAST(0.5 AS DOUBLE)) / CAST(2147483647 AS DOUBLE))"


def gauss_sql(stream: str) -> str:
    return f"(sqrt(-2 * ln({mix_sql(stream + ':r')})) * cos(2 * pi() * {mix_sql(stream + ':a')}))"


# --- scored rows --------------------------------------------------------------------

def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with a fixed score that has ties, a fold, a domain and a split."""
    z = F.lit(0.05) * F.col("src_bytes") + F.col("same_srv_rate") - F.lit(4.0)
    return labelled(spark, sf_dir).select(
        "row_id", "label", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 3).alias("score"),
        F.pmod(F.col("row_id"), F.lit(3)).cast("int").alias("fold"), F.col("flag").alias("domain"),
        F.when(unit_hash("row_id", seed=7) < 0.3, "test").otherwise("train").alias("split"),
    )


SCORES = LABELLED + f""", scores AS (
  SELECT row_id, label,
    round(1 / (1 + exp(-(0.05 * src_bytes + same_srv_rate - CAST(4 AS DOUBLE)))), 3) AS score,
    CAST(row_id % 3 AS INTEGER) AS fold, flag AS domain,
    CASE WHEN {unit_sql(seed=7)} < 0.3 THEN 'test' ELSE 'train' END AS split
  FROM labelled)"""


# --- packets --------------------------------------------------------------------------

def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets between fifty hosts; some lack an address."""
    e = table(spark, sf_dir, "events")
    a, b = F.pmod("user_id", F.lit(50)), F.pmod("event_id", F.lit(50))
    return e.select(
        "ts", F.ceil("value").cast("int").alias("length"),
        F.when(~((F.col("event_type") == "signup") & (F.col("value") < 1)),
               F.concat(F.lit("10.0.0."), a.cast("string"))).alias("src_ip"),
        F.when(F.col("event_type") != "view", F.pmod("user_id", F.lit(7)).cast("string")).alias("src_port"),
        F.concat(F.lit("10.0.0."), b.cast("string")).alias("dst_ip"),
        F.lit("443").alias("dst_port"),
        F.when(F.col("event_type") == "error", "UDP").otherwise("TCP").alias("proto"),
    )


PACKETS = """packets AS (
  SELECT ts, CAST(ceil(value) AS INTEGER) AS length,
    CASE WHEN NOT (event_type = 'signup' AND value < 1) THEN '10.0.0.' || (user_id % 50) END AS src_ip,
    CASE WHEN event_type <> 'view' THEN CAST(user_id % 7 AS VARCHAR) END AS src_port,
    '10.0.0.' || (event_id % 50) AS dst_ip, '443' AS dst_port,
    CASE WHEN event_type = 'error' THEN 'UDP' ELSE 'TCP' END AS proto
  FROM events),
keyed AS (
  SELECT ts, length, proto, coalesce(src_port, '0') AS sp, dst_port AS dp, src_ip AS si, dst_ip AS di,
    (src_ip, coalesce(src_port, '0')) <= (dst_ip, dst_port) AS forward
  FROM packets WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL),
sided AS (
  SELECT ts, length, proto, forward,
    CASE WHEN forward THEN si ELSE di END AS a_ip, CASE WHEN forward THEN sp ELSE dp END AS a_port,
    CASE WHEN forward THEN di ELSE si END AS b_ip, CASE WHEN forward THEN dp ELSE sp END AS b_port
  FROM keyed)"""
