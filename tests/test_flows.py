import datetime as dt

import pytest
from pyspark.sql import functions as F

from netweave.checks.base import NUMERIC, flows
from netweave.operators.features import FlowPreprocessor
from netweave.operators.flows import assemble_flows, to_nb15
from netweave.plans.schemas import NB15_COLUMNS
from netweave.streaming import run_to_table, score_stream, session_flows, stream_table

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, length int, src_ip string, src_port string, dst_ip string, dst_port string, proto string"


def packet(at, length, src, dst, proto="TCP"):
    return (T0 + dt.timedelta(seconds=at), length, *src, *dst, proto)


A, B, C = ("10.0.0.1", "5"), ("10.0.0.2", "80"), (None, "1")
PACKETS = [packet(0, 10, A, B), packet(2, 30, B, A), packet(4, 20, A, B), packet(1, 7, A, B, "UDP"), packet(5, 99, C, B)]


def test_both_directions_make_one_flow(spark):
    df = spark.createDataFrame(PACKETS, SCHEMA)
    out = {r["proto"]: r for r in assemble_flows(df).collect()}
    tcp, udp = out["TCP"], out["UDP"]
    assert len(out) == 2  # the packet without an address is dropped
    assert (tcp["dur"], tcp["spkts"], tcp["dpkts"], tcp["sbytes"], tcp["dbytes"]) == (4.0, 2, 1, 30, 30)
    assert (tcp["rate"], tcp["smean"], tcp["dmean"]) == (15.0, 15.0, 30.0)
    assert (udp["dur"], udp["rate"], udp["dpkts"], udp["dmean"]) == (0.0, 0.0, 0, 0.0)


def test_totals_on_both_sides(spark):
    df = spark.createDataFrame(PACKETS, SCHEMA)
    nb = to_nb15(assemble_flows(df, split_directions=False))
    assert nb.columns == [c for c in NB15_COLUMNS if c != "id"]
    r = nb.where("proto = 'TCP'").first()
    assert (r["spkts"], r["dpkts"], r["sbytes"], r["service"], r["attack_cat"], r["label"]) == (3, 3, 60, "-", "Normal", 0)


def test_missing_ports_count_as_zero(spark):
    rows = [packet(0, 1, ("a", None), ("b", "0"))]
    assert assemble_flows(spark.createDataFrame(rows, SCHEMA)).first()["a_port"] == "0"


def key_rows(df):
    cols = ["a_ip", "a_port", "b_ip", "b_port", "proto", "session_start", "spkts", "dpkts", "sbytes", "dur"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def capture(spark, tmp_path_factory):
    """Three files of packets; the last one holds only a late sentinel that closes every session."""
    folder = tmp_path_factory.mktemp("capture")
    rows = [packet(60 * i, 10 + i % 5, ("h%d" % (i % 7), "1"), ("h%d" % (i % 3), "2")) for i in range(200)]
    parts = [rows[:120], rows[120:], [packet(10**6, 1, ("z", "1"), ("z", "2"))]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "p"))
    return str(folder / "p")


def test_streamed_sessions_equal_batch_sessions(spark, capture):
    batch = session_flows(spark.read.parquet(capture), "10 minutes")
    live = run_to_table(session_flows(stream_table(spark, capture, files_per_trigger=1), "10 minutes", "1 hour"), "s")
    want = [r for r in key_rows(batch) if r[0] != "z"]
    assert key_rows(live) == want and len(want) > 7


def test_open_session_stays_in_the_stream(spark, tmp_path):
    rows = [packet(0, 1, A, B), packet(10**5, 1, A, B)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "p"))
    live = run_to_table(session_flows(stream_table(spark, str(tmp_path / "p")), "10 minutes"), "s")
    assert live.count() == 1


def test_late_packets_are_dropped(spark, tmp_path):
    path = str(tmp_path / "p")
    # A batch drops what the watermark of the batch before it rules out.
    for part in ([packet(10**5, 1, A, B)], [packet(10**5 + 1, 1, A, B)], [packet(0, 1, A, B)], [packet(10**6, 1, A, B)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    live = run_to_table(session_flows(stream_table(spark, path, 1), "10 minutes", "10 minutes"), "s")
    assert [(r["session_start"], r["spkts"]) for r in live.collect()] == [(T0 + dt.timedelta(seconds=10**5), 2)]


def test_streamed_scores_equal_batch_scores(spark, sf):
    df = flows(spark, sf)
    model = FlowPreprocessor(numeric=NUMERIC, text=["flag"], select_threshold=None, use_pairs=False).fit(df)
    source = f"{sf}/events.parquet"
    live = stream_table(spark, source)
    assert live.isStreaming
    from netweave.checks.streams import _Streaming

    out = run_to_table(score_stream(flows(_Streaming(spark), sf), model, ["row_id"]), "scored")
    want = model.transform(df, ["row_id"])
    assert out.exceptAll(want).count() == 0 and out.count() == want.count()
    assert want.agg(F.count("*")).first()[0] == 1000
