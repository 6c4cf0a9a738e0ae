"""Streaming queries drained to a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.checks.base import NUMERIC, PACKETS, flows, packets, query, rounded
from netweave.checks.features import ROBUST, _rounded_sql
from netweave.operators.features import FlowPreprocessor
from netweave.streaming import run_to_table, score_stream, session_flows, stream_table


class _Streaming:
    """Stands in for the session, so that the shared views read a stream."""

    def __init__(self, spark):
        self.read = self
        self._spark = spark

    def parquet(self, path):
        return stream_table(self._spark, path)


@query("stream_score", f"WITH {ROBUST} SELECT row_id, {_rounded_sql(NUMERIC)} FROM robust")
def stream_score(spark, sf):
    """Preprocessing fitted on the table and applied to the stream of its files."""
    chain = FlowPreprocessor(numeric=NUMERIC, select_threshold=None, use_pairs=False, standardize=False)
    model = chain.fit(flows(spark, sf))
    live = flows(_Streaming(spark), sf)
    return rounded(run_to_table(score_stream(live, model, ["row_id"]), "scored"))


_SESSIONS = """s AS (
  SELECT *, sum(opens) OVER (PARTITION BY a_ip, a_port, b_ip, b_port, proto ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY a_ip, a_port, b_ip, b_port, proto ORDER BY ts) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS opens
    FROM sided)),
f AS (SELECT a_ip, a_port, b_ip, b_port, proto, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS packets,
    sum(length)::BIGINT AS bytes, count(*) FILTER (forward) AS spkts FROM s GROUP BY ALL)"""


@query("session_flows", f"""
WITH {PACKETS}, {_SESSIONS}
SELECT a_ip, a_port, b_ip, b_port, proto, round(epoch_us(first_ts) / 1000000::DOUBLE, 3) AS started, spkts,
  packets - spkts AS dpkts, round((epoch_us(last_ts) - epoch_us(first_ts)) / 1000000::DOUBLE, 6) AS dur FROM f
""")
def batch_sessions(spark, sf):
    return _sessions(session_flows(packets(spark, sf), "1 day"))


@query("stream_session_flows", f"""
WITH {PACKETS}, {_SESSIONS}
SELECT a_ip, a_port, b_ip, b_port, proto, round(epoch_us(first_ts) / 1000000::DOUBLE, 3) AS started, spkts,
  packets - spkts AS dpkts, round((epoch_us(last_ts) - epoch_us(first_ts)) / 1000000::DOUBLE, 6) AS dur
FROM f WHERE date_trunc('millisecond', last_ts + INTERVAL 1 DAY) <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM sided)
""")
def stream_sessions(spark, sf):
    """Only flows that the watermark has closed leave the stream."""
    live = packets(_Streaming(spark), sf)
    return _sessions(run_to_table(session_flows(live, "1 day", "10 minutes"), "sessions"))


def _sessions(df):
    started = F.round(F.unix_micros("session_start") / 1e6, 3)
    return rounded(df.select("a_ip", "a_port", "b_ip", "b_port", "proto", started.alias("started"), "spkts", "dpkts", "dur"))
