"""Scans, conformance, expressions, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.checks.base import FLOWS, flows, query, rounded, table
from netweave.functions import (
    binary_label,
    clean_infinite,
    clip,
    coerce_double,
    detect_label_rule,
    flag_indicator,
    log1p_clipped,
    map_contains,
    map_values,
    smoothed_ratio,
    tcp_flag_state,
)
from netweave.operators.features import interactions, packed_products
from netweave.operators.ordering import with_row_ids
from netweave.operators.profile import attack_family, label_lookup
from netweave.operators.tables import coerce_if_all, convert, fill_constant, fill_mean, source_tag, union_all, union_tagged
from netweave.plans import SPECS, conform, vocab
from netweave.plans.mapping import drop_present, rename_present
from netweave.plans.schemas import CIC_COLUMNS, KDD_COLUMNS, NB15_COLUMNS, UNSW_RAW_COLUMNS
from netweave.session import scratch_path
from netweave.sources import read_flows, read_flows_reported, read_table, write_csv

# --- scans and sinks ---------------------------------------------------------------


@query("scan_project", """
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 25
""")
def scan_project(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_tax"]
    df = read_table(spark, f"{sf}/lineitem.parquet", cols)
    return drop_present(df.where("l_quantity > 25"), "l_tax", "not_there")


@query("csv_roundtrip", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total,
  sum(o_orderkey)::BIGINT AS keys
FROM orders GROUP BY 1, 2
""")
def csv_roundtrip(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = scratch_path(spark, "orders-csv")
    write_csv(orders, path)
    back = read_flows(spark, [path, path + "-absent"],
                      "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string")
    return back.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.sum("o_orderkey").alias("keys"))


@query("csv_by_name", """
SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer
""")
def csv_by_name(spark, sf):
    """Two files whose columns stand in different orders, and one that does not exist."""
    customer = table(spark, sf, "customer")
    first, second = scratch_path(spark, "customers-csv"), scratch_path(spark, "customers-csv")
    half = F.col("c_custkey") % 2 == 0
    write_csv(customer.where(half).selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS balance"), first)
    write_csv(customer.where(~half).selectExpr("c_acctbal AS balance", "c_name AS name", "c_custkey AS key"), second)
    df, skipped = read_flows_reported(spark, [first, first + "-absent", second], "key bigint, name string, balance double")
    assert list(skipped) == [first + "-absent"]
    return df


@query("csv_orders_by_name", """
SELECT o_orderkey AS key, o_orderpriority AS priority, o_totalprice::DOUBLE AS price FROM orders
""")
def csv_orders_by_name(spark, sf):
    """As ``csv_by_name``, over a table that grows."""
    orders = table(spark, sf, "orders")
    first, second = scratch_path(spark, "orders-by-name"), scratch_path(spark, "orders-by-name")
    write_csv(orders.where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS key", "o_orderpriority AS priority", "o_totalprice AS price"), first)
    write_csv(orders.where("o_orderkey % 2 <> 0").selectExpr("o_totalprice AS price", "o_orderpriority AS priority", "o_orderkey AS key"), second)
    df, skipped = read_flows_reported(spark, [first, first + "-absent", second], "key bigint, priority string, price double")
    assert list(skipped) == [first + "-absent"]
    return df


# --- conformance ---------------------------------------------------------------------

def _zeros(names):
    return ", ".join(f'CAST(0 AS DOUBLE) AS "{n}"' for n in names)


def cic_source(spark, sf):
    """A table in the CIC layout, header blanks and dirty cells included."""
    f = flows(spark, sf)
    label = (
        F.when(F.col("labels") == "normal", " BENIGN ")
        .when((F.col("labels") == "neptune") & (F.col("flag") == "SF"), "DDoS")
        .when(F.col("labels") == "neptune", "Web Attack – Brute Force")
        .when(F.col("flag") == "S0", "PortScan").when(F.col("flag") == "SF", "Heartbleed")
        .when(F.col("src_bytes") > 200, F.lit(None)).otherwise("Unknown thing")
    )
    return f.select(
        F.col("row_id").alias("row_id"),
        F.col("duration").alias(" Flow Duration"),
        F.when(F.col("flag") == "REJ", F.lit("n/a")).otherwise(F.col("src_bytes").cast("string")).alias("Total Fwd Packets"),
        F.col("src_bytes").alias("Total Length of Fwd Packets"),
        F.col("dst_bytes").alias(" Total Length of Bwd Packets"),
        F.when(F.col("duration") == 0, F.lit(float("inf"))).otherwise(F.col("src_bytes") / F.col("duration")).alias("Flow Bytes/s"),
        F.col("same_srv_rate").alias("Flow IAT Mean"),
        F.when(F.col("protocol_type") != "view", F.col("same_srv_rate") * 2).alias("Fwd IAT Mean"),
        F.col("src_bytes").alias("Fwd Header Length"),
        label.alias(" Label"),
    )


CIC = FLOWS + """, cic AS (
  SELECT row_id, duration, src_bytes, dst_bytes, same_srv_rate, protocol_type,
    CASE WHEN flag = 'REJ' THEN NULL ELSE src_bytes END AS fwd_packets,
    CASE WHEN labels = 'normal' THEN ' BENIGN '
      WHEN labels = 'neptune' AND flag = 'SF' THEN 'DDoS'
      WHEN labels = 'neptune' THEN 'Web Attack – Brute Force'
      WHEN flag = 'S0' THEN 'PortScan' WHEN flag = 'SF' THEN 'Heartbleed'
      WHEN src_bytes > 200 THEN NULL ELSE 'Unknown thing' END AS label_text
  FROM flows)"""

_NB_MAPPED = ("dur", "proto", "service", "state", "spkts", "sbytes", "dbytes", "rate", "sinpkt", "swin",
              "attack_cat", "label", "id")


_OVERLAY = """row_number() OVER (ORDER BY row_id) - 1 AS id, duration AS dur, 'unknown' AS proto, 'unknown' AS service,
  'unknown' AS state, coalesce(fwd_packets, 0) AS spkts, src_bytes AS sbytes, dst_bytes AS dbytes,
  round((src_bytes + dst_bytes) / (duration + 0.000001), 4) AS rate,
  CASE WHEN protocol_type <> 'view' THEN same_srv_rate * 2 ELSE 0 END AS sinpkt, src_bytes AS swin,
  CASE WHEN trim(coalesce(label_text, '')) = 'BENIGN' THEN 'Normal'
    WHEN label_text LIKE '%DoS%' THEN 'DoS' WHEN label_text LIKE '%PortScan%' THEN 'Reconnaissance'
    WHEN label_text LIKE '%Brute Force%' THEN 'BruteForce' WHEN label_text LIKE '%Heartbleed%' THEN 'Exploits'
    ELSE 'Other' END AS attack_cat,
  CASE WHEN trim(coalesce(label_text, '')) = 'BENIGN' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label"""


@query("conform_overlay", f"""
WITH {CIC}
SELECT {_OVERLAY}, {_zeros(c for c in NB15_COLUMNS if c not in _NB_MAPPED)} FROM cic
""")
def conform_overlay(spark, sf):
    out = convert(cic_source(spark, sf), SPECS["cic_to_nb15"], order_by=["row_id"])
    return out.withColumn("rate", F.round("rate", 4))


_NB_DERIVED = ("sttl", "dttl", "sload", "dload")


@query("conform_cic_derived", f"""
WITH {CIC}
SELECT {_OVERLAY}, CAST(64 AS DOUBLE) AS sttl, CAST(64 AS DOUBLE) AS dttl,
  round(src_bytes / (duration + 0.000001), 4) AS sload, round(dst_bytes / (duration + 0.000001), 4) AS dload,
  {_zeros(c for c in NB15_COLUMNS if c not in _NB_MAPPED + _NB_DERIVED)} FROM cic
""")
def conform_cic_derived(spark, sf):
    """The conversion that also fills time-to-live and load."""
    out = convert(cic_source(spark, sf), SPECS["cic_to_nb15_derived"], order_by=["row_id"])
    return out.withColumns({c: F.round(c, 4) for c in ("rate", "sload", "dload")})


def cic_trimmed(spark, sf):
    """The same source with plain labels and packet counts in both directions."""
    return cic_source(spark, sf).withColumns({
        " Label": F.trim(F.col("` Label`")), "Total Fwd Packets": F.col("Total Fwd Packets").try_cast("double"),
        "Total Backward Packets": F.col("` Total Length of Bwd Packets`")})


_SHORT_LABELS = """CASE WHEN trim(label_text) = 'BENIGN' THEN 'Normal' WHEN label_text LIKE '%DoS%' THEN 'DoS'
    WHEN label_text LIKE '%PortScan%' THEN 'Reconnaissance' WHEN label_text LIKE '%Brute Force%' THEN 'BruteForce'
    ELSE 'Other' END AS attack_cat,
  CASE WHEN trim(label_text) = 'BENIGN' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label"""


@query("conform_cic_direct", f"""
WITH {CIC}
SELECT duration AS dur, '0' AS proto, '0' AS service, '0' AS state, coalesce(fwd_packets, 0) AS spkts, dst_bytes AS dpkts,
  {_SHORT_LABELS}, {_zeros(c for c in NB15_COLUMNS if c not in ("dur", "proto", "service", "state", "spkts", "dpkts", "attack_cat", "label"))}
FROM cic
""")
def conform_cic_direct(spark, sf):
    return conform(cic_trimmed(spark, sf), SPECS["cic_to_nb15_direct"])


@query("conform_cic_minimal", f"""
WITH {CIC} SELECT duration AS dur, fwd_packets AS sbytes, dst_bytes AS dbytes, {_SHORT_LABELS} FROM cic
""")
def conform_cic_minimal(spark, sf):
    return conform(cic_trimmed(spark, sf), SPECS["cic_to_nb15_minimal"])


_CIC_KDD = ("duration", "protocol_type", "service", "flag", "src_bytes", "srv_count", "serror_rate",
            "same_srv_rate", "labels")


@query("conform_cic_to_kdd", f"""
WITH {CIC}
SELECT duration, 'tcp' AS protocol_type, 'http' AS service, 'SF' AS flag, coalesce(fwd_packets, 0) AS src_bytes,
  CASE WHEN duration = 0 THEN 'inf'::DOUBLE ELSE round(src_bytes / duration, 6) END AS srv_count,
  same_srv_rate AS serror_rate, CASE WHEN protocol_type <> 'view' THEN same_srv_rate * 2 ELSE 0 END AS same_srv_rate,
  CASE label_text WHEN 'DDoS' THEN 'neptune' WHEN 'PortScan' THEN 'ipsweep'
    WHEN 'Web Attack – Brute Force' THEN 'guess_passwd' ELSE 'normal' END AS labels,
  {_zeros(c for c in KDD_COLUMNS if c not in _CIC_KDD)}
FROM cic
""")
def conform_cic_to_kdd(spark, sf):
    out = conform(cic_source(spark, sf), SPECS["cic_to_kdd"])
    rate = F.col("srv_count")
    return out.withColumn("srv_count", F.when(rate == float("inf"), rate).otherwise(F.round(rate, 6)))


@query("conform_cic_binary", f"""
WITH {CIC}
SELECT CASE WHEN label_text = 'BENIGN' THEN 'normal' ELSE 'attack' END AS labels, count(*) AS n,
  round(sum(coalesce(fwd_packets, 0)), 4) AS src_bytes FROM (
    SELECT trim(label_text) AS label_text, fwd_packets FROM cic) GROUP BY 1
""")
def conform_cic_binary(spark, sf):
    df = cic_source(spark, sf)
    df = df.withColumn(" Label", F.trim(F.col("` Label`")))
    out = conform(df, SPECS["cic_to_kdd_binary"])
    return out.groupBy("labels").agg(F.count("*").alias("n"), F.round(F.sum("src_bytes"), 4).alias("src_bytes"))


def nb15_source(spark, sf):
    f = flows(spark, sf)
    category = (
        F.when(F.col("labels") == "normal", "Normal").when(F.col("flag") == "SF", "Generic")
        .when(F.col("flag") == "S0", "Worms").otherwise("Mystery")
    )
    return f.select(
        "row_id", F.col("duration").alias("dur"), F.col("protocol_type").alias("proto"), F.col("flag").alias("state"),
        F.col("src_bytes").alias("sbytes"), F.col("dst_bytes").alias("dbytes"),
        F.when(F.col("flag") != "S0", F.col("same_srv_rate")).alias("sttl"), category.alias("attack_cat"))


_NB_KDD = ("duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "count", "labels")


@query("conform_defaults", f"""
WITH {FLOWS}
SELECT duration, protocol_type, 'http' AS service, flag, src_bytes, dst_bytes,
  CASE WHEN flag <> 'S0' THEN same_srv_rate END AS "count",
  CASE WHEN labels = 'normal' THEN 'normal' WHEN flag = 'SF' THEN 'neptune' WHEN flag = 'S0' THEN 'warezclient'
    ELSE 'normal' END AS labels,
  {_zeros(c for c in KDD_COLUMNS if c not in _NB_KDD)}
FROM flows
""")
def conform_defaults(spark, sf):
    return conform(nb15_source(spark, sf), SPECS["nb15_to_kdd"])


def ukm_source(spark, sf):
    f = flows(spark, sf)
    kind = (
        F.when(F.col("labels") == "normal", "Normal").when(F.col("flag") == "SF", "UDP data flood")
        .when(F.col("flag") == "S0", "Port scanning").otherwise("Something else")
    )
    return f.select(
        "row_id", F.col("duration").alias(" dur"),
        F.when(F.col("protocol_type") == "error", 17).when(F.col("protocol_type") == "view", 1)
        .when(F.col("protocol_type") == "click", 99).otherwise(6).alias("trnspt"),
        F.col("protocol_type").alias("srvs"), F.pmod("user_id", F.lit(8)).cast("int").alias("flag_n"),
        F.col("src_bytes").alias("src_byts"), F.col("dst_bytes").alias("dst_bytes"),
        F.pmod("user_id", F.lit(5)).cast("int").alias("src_pkts"), F.col("same_srv_rate").alias("host_dst _count"),
        F.col("src_bytes").alias("dst_host_count"), kind.alias("Class"),
        (F.col("labels") != "normal").cast("int").alias("Binary"))


UKM = FLOWS + """, ukm AS (
  SELECT row_id, duration AS dur,
    CASE protocol_type WHEN 'error' THEN 17 WHEN 'view' THEN 1 WHEN 'click' THEN 99 ELSE 6 END AS trnspt,
    protocol_type AS srvs, CAST(user_id % 8 AS INTEGER) AS flag_n, src_bytes AS src_byts, dst_bytes,
    CAST(user_id % 5 AS DOUBLE) AS src_pkts, same_srv_rate AS host_dst, src_bytes AS dst_host_count,
    CASE WHEN labels = 'normal' THEN 'Normal' WHEN flag = 'SF' THEN 'UDP data flood'
      WHEN flag = 'S0' THEN 'Port scanning' ELSE 'Something else' END AS kind,
    CAST(labels <> 'normal' AS INTEGER) AS bin
  FROM flows)"""

_UKM_NB = ("dur", "proto", "service", "state", "spkts", "dbytes", "ct_dst_ltm", "label", "attack_cat", "id", "rate")


@query("conform_first_present", f"""
WITH {UKM}
SELECT row_number() OVER (ORDER BY row_id) AS id, dur, CAST(trnspt AS VARCHAR) AS proto, srvs AS service,
  'unknown' AS state, src_pkts AS spkts, dst_bytes AS dbytes, dst_host_count AS ct_dst_ltm,
  CAST(bin AS DOUBLE) AS label, kind AS attack_cat, round(dst_bytes / (dur + 1), 6) AS rate,
  CAST(0 AS DOUBLE) AS src_avg_byts, round(dst_bytes, 6) AS dst_avg_byts,
  {_zeros(c for c in NB15_COLUMNS if c not in _UKM_NB)}
FROM ukm
""")
def conform_first_present(spark, sf):
    out = convert(ukm_source(spark, sf), SPECS["ukm_to_nb15"], order_by=["row_id"], start=1)
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "dst_avg_byts")})


_UKM_KDD = ("duration", "protocol_type", "service", "flag", "src_bytes", "count", "dst_host_count",
            "dst_host_srv_count", "labels")


@query("conform_ukm_to_kdd", f"""
WITH {UKM}
SELECT dur AS duration,
  CASE trnspt WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'tcp' END AS protocol_type, srvs AS service,
  CASE flag_n WHEN 1 THEN 'S0' WHEN 2 THEN 'S1' WHEN 3 THEN 'S2' WHEN 4 THEN 'S3' WHEN 5 THEN 'OTH' ELSE 'SF' END AS flag,
  src_byts AS src_bytes, src_pkts AS "count", dst_host_count, host_dst AS dst_host_srv_count,
  CASE kind WHEN 'UDP data flood' THEN 'neptune' WHEN 'Port scanning' THEN 'nmap' ELSE 'normal' END AS labels,
  {_zeros(c for c in KDD_COLUMNS if c not in _UKM_KDD)}
FROM ukm
""")
def conform_ukm_to_kdd(spark, sf):
    return conform(ukm_source(spark, sf), SPECS["ukm_to_kdd"])


@query("conform_rename", f"""
WITH {UKM}
SELECT row_id, dst_bytes, dur AS duration, CAST(trnspt AS DOUBLE) AS protocol_type, srvs AS service,
  CAST(flag_n AS DOUBLE) AS flag, src_byts AS num_outbound_cmds, src_pkts AS num_failed_logins,
  dst_host_count AS srv_serror_rate, host_dst AS rerror_rate, kind AS labels, CAST(bin AS DOUBLE) AS label_binary
FROM ukm
""")
def conform_rename(spark, sf):
    return conform(ukm_source(spark, sf), SPECS["ukm_to_nsl"])


@query("rename_only", """
SELECT o_orderkey AS id, o_totalprice AS sbytes FROM orders
""")
def rename_only(spark, sf):
    names = {"o_orderkey": "id", "o_totalprice": "sbytes", "absent": "dbytes"}
    return rename_present(table(spark, sf, "orders"), names, only=True)


def ctu_source(spark, sf):
    f = flows(spark, sf)
    return f.select(
        F.col("duration").alias("Flow Duration"), F.col("src_bytes").alias("TotLen Fwd Pkts"),
        F.col("dst_bytes").alias("TotLen Bwd Pkts"), F.col("same_srv_rate").alias("Flow Byts/s"),
        F.pmod("user_id", F.lit(9)).alias("Tot Fwd Pkts"), F.col("protocol_type").alias("Protocol"),
        F.lit(0).alias("Tot Bwd Pkts"), F.col("src_bytes").alias("Fwd Pkt Len Mean"),
        F.col("same_srv_rate").alias("Flow IAT Mean"), (F.col("labels") != "normal").cast("int").alias("Label"))


_CTU_GIVEN = {"dur": "duration", "sbytes": "src_bytes", "dbytes": "dst_bytes", "rate": "same_srv_rate",
              "spkts": "CAST(user_id % 9 AS DOUBLE)", "dpkts": "CAST(0 AS DOUBLE)", "smean": "src_bytes",
              "tcprtt": "same_srv_rate", "ct_srv_src": "duration", "ct_state_ttl": "src_bytes"}
_CTU_ABSENT = [c for c in NB15_COLUMNS if c not in _CTU_GIVEN and c not in
               ("id", "proto", "service", "state", "attack_cat", "label")]


@query("conform_align", f"""
WITH {FLOWS}
SELECT {", ".join(f"{v} AS {k}" for k, v in _CTU_GIVEN.items())}, '-1' AS id, protocol_type AS proto,
  '-1' AS service, '-1' AS state, CASE WHEN labels <> 'normal' THEN 'Bot' ELSE 'Normal' END AS attack_cat,
  CAST(labels <> 'normal' AS DOUBLE) AS label,
  {", ".join(f"CAST(-1 AS DOUBLE) AS {c}" for c in _CTU_ABSENT)}
FROM flows
""")
def conform_align(spark, sf):
    return conform(ctu_source(spark, sf), SPECS["ctu_to_nb15"])


_UNSW_GIVEN = {"dur": "duration", "sbytes": "src_bytes", "dbytes": "dst_bytes", "Sload": "same_srv_rate",
               "Spkts": "CAST(user_id % 9 AS DOUBLE)", "Dpkts": "CAST(0 AS DOUBLE)", "smeansz": "src_bytes",
               "Sintpkt": "same_srv_rate", "dmeansz": "CAST(0 AS DOUBLE)", "Dintpkt": "CAST(0 AS DOUBLE)",
               "Label": "CAST(labels <> 'normal' AS DOUBLE)"}
_UNSW_TEXT = ("srcip", "dstip", "proto", "state", "service")
_UNSW_COUNTS = ("is_sm_ips_ports", "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "ct_srv_src",
                "ct_srv_dst", "ct_dst_ltm", "ct_src_ ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm")
_UNSW_EMPTY = [c for c in UNSW_RAW_COLUMNS if c not in _UNSW_GIVEN and c not in _UNSW_TEXT
               and c not in _UNSW_COUNTS and c != "attack_cat"]


@query("conform_ctu_to_unsw", f"""
WITH {FLOWS}
SELECT {", ".join(f'{v} AS "{k}"' for k, v in _UNSW_GIVEN.items())},
  {", ".join(f"'' AS {c}" for c in _UNSW_TEXT)}, {_zeros(_UNSW_COUNTS)},
  {", ".join(f'CAST(NULL AS DOUBLE) AS "{c}"' for c in _UNSW_EMPTY)},
  CASE WHEN labels = 'normal' THEN 'Normal' ELSE 'Attack' END AS attack_cat
FROM flows
""")
def conform_ctu_to_unsw(spark, sf):
    return conform(ctu_source(spark, sf), SPECS["ctu_to_unsw"])


@query("conform_mqtt_to_kdd", f"""
WITH {FLOWS}
SELECT same_srv_rate AS duration, src_bytes, src_bytes AS dst_bytes, 'tcp' AS protocol_type, 'mqtt' AS service,
  CASE flag WHEN 'S0' THEN 'S1' WHEN 'REJ' THEN 'S2' ELSE 'SF' END AS flag,
  CAST(user_id % 4 AS DOUBLE) AS dst_host_srv_rerror_rate,
  CASE protocol_type WHEN 'view' THEN 'normal' WHEN 'error' THEN 'smurf' WHEN 'click' THEN 'back' ELSE 'normal' END AS labels,
  {_zeros(c for c in KDD_COLUMNS if c not in ("duration", "src_bytes", "dst_bytes", "protocol_type", "service", "flag", "dst_host_srv_rerror_rate", "labels"))}
FROM flows
""")
def conform_mqtt_to_kdd(spark, sf):
    source = flows(spark, sf).select(
        F.col("same_srv_rate").alias("tcp.time_delta"), F.col("src_bytes").alias("tcp.len"),
        F.when(F.col("flag") == "SF", "0x00000010").when(F.col("flag") == "S0", "0x00000018")
        .otherwise("0x00000014").alias("tcp.flags"),
        F.pmod("user_id", F.lit(4)).cast("string").alias("mqtt.msgtype"),
        F.when(F.col("protocol_type") == "view", "legitimate").when(F.col("protocol_type") == "error", "dos")
        .when(F.col("protocol_type") == "click", "flood").otherwise("strange").alias("target"))
    return conform(source, SPECS["mqtt_to_kdd"])


_CIC_GIVEN = ("Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Fwd IAT Mean", "SYN Flag Count",
              "RST Flag Count", "Label")


@query("conform_kdd_to_cic", f"""
WITH {FLOWS}
SELECT duration AS "Flow Duration", src_bytes AS "Total Fwd Packets", dst_bytes AS "Total Backward Packets",
  same_srv_rate AS "Fwd IAT Mean", CAST(flag = 'S0' AS DOUBLE) AS "SYN Flag Count",
  CAST(flag = 'REJ' AS DOUBLE) AS "RST Flag Count", {_zeros(c for c in CIC_COLUMNS if c not in _CIC_GIVEN)},
  CASE labels WHEN 'normal' THEN 'BENIGN' WHEN 'neptune' THEN 'DoS' ELSE 'PortScan' END AS "Label"
FROM flows
""")
def conform_kdd_to_cic(spark, sf):
    f = flows(spark, sf)
    flag = F.when(F.col("flag") == "S0", "SYN").when(F.col("flag") == "REJ", "RST").otherwise("SF")
    return conform(f.withColumn("flag", flag), SPECS["kdd_to_cic"])


@query("conform_nsl_to_nb15", f"""
WITH {FLOWS}
SELECT duration AS dur, protocol_type AS proto, flag AS state, 'unknown' AS service, src_bytes AS sbytes, dst_bytes AS dbytes,
  round((src_bytes + dst_bytes) / (duration + 1), 6) AS rate, src_bytes AS sinpkt, dst_bytes AS dinpkt,
  labels AS attack_cat, CAST(labels <> 'normal' AS DOUBLE) AS label,
  {_zeros(c for c in NB15_COLUMNS if c not in ("id", "dur", "proto", "service", "state", "sbytes", "dbytes", "rate", "sload", "dload", "sinpkt", "dinpkt", "attack_cat", "label"))}
FROM flows
""")
def conform_nsl_to_nb15(spark, sf):
    f = flows(spark, sf).withColumns({"attack_type": F.col("labels"), "label": F.col("labels")})
    return conform(f, SPECS["nsl_to_nb15"]).withColumn("rate", F.round("rate", 6))


@query("conform_bot_to_kdd", f"""
WITH {FLOWS}
SELECT duration, src_bytes, dst_bytes, same_srv_rate, flag, protocol_type, '0' AS service,
  CASE WHEN labels = 'normal' THEN 'normal' ELSE 'attack' END AS labels,
  {_zeros(c for c in KDD_COLUMNS if c not in ("duration", "src_bytes", "dst_bytes", "same_srv_rate", "flag", "protocol_type", "service", "labels"))}
FROM flows
""")
def conform_bot_to_kdd(spark, sf):
    f = flows(spark, sf).withColumn("category", F.concat(F.lit(" "), F.initcap("labels"), F.lit(" "))).drop("labels")
    return conform(f, SPECS["bot_to_kdd"])


@query("row_ids", """
SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS id,
  l_orderkey, l_linenumber FROM lineitem
""")
def row_ids(spark, sf):
    li = table(spark, sf, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return with_row_ids(li.select(*order), order, start=1).select("id", "l_orderkey", "l_linenumber")


# --- expressions -----------------------------------------------------------------------

def dirty(spark, sf):
    """Numbers as text with the usual accidents."""
    e = table(spark, sf, "events")
    text = (
        F.when((F.col("event_type") == "error") & (F.col("value") > 50), "n/a")
        .when((F.col("event_type") == "signup") & (F.col("value") > 50), "1d")
        .when((F.col("event_type") == "view") & (F.col("value") > 90), "NaN")
        .when((F.col("event_type") == "view") & (F.col("value") > 80), F.lit(None))
        .when((F.col("event_type") == "view") & (F.col("value") > 70), "")
        .otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    )
    ident = F.col("user_id").cast("string").alias("ident")
    return e.select("event_id", "event_type", text.alias("raw"), "value", ident)


DIRTY = """dirty AS (
  SELECT event_id, event_type, value, CASE
    WHEN event_type = 'error' AND value > 50 THEN 'n/a' WHEN event_type = 'signup' AND value > 50 THEN '1d'
    WHEN event_type = 'view' AND value > 90 THEN 'NaN' WHEN event_type = 'view' AND value > 80 THEN NULL
    WHEN event_type = 'view' AND value > 70 THEN '' ELSE ' ' || value || ' ' END AS raw
  FROM events),
clean AS (
  SELECT *, CASE WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS number FROM dirty)"""


@query("coerce_numeric", f"WITH {DIRTY} SELECT event_id, number FROM clean")
def coerce_numeric(spark, sf):
    return dirty(spark, sf).select("event_id", coerce_double(F.col("raw")).alias("number"))


@query("coerce_if_all", f"""
WITH {DIRTY}
SELECT event_id, raw, CAST(user_id AS DOUBLE) AS ident FROM clean JOIN events USING (event_id)
""")
def coerce_all(spark, sf):
    return coerce_if_all(dirty(spark, sf).select("event_id", "raw", "ident"), ["raw", "ident"])


@query("fill_null", f"""
WITH {DIRTY}
SELECT event_id, coalesce(number, 0) AS number, coalesce(raw, '') AS raw FROM clean
""")
def fill_null(spark, sf):
    df = dirty(spark, sf).select("event_id", coerce_double(F.col("raw")).alias("number"), "raw")
    return fill_constant(fill_constant(df, 0, ["number"]), "", ["raw"])


@query("fill_mean", f"""
WITH {DIRTY}
SELECT event_id, round(coalesce(number, (SELECT avg(number) FROM clean)), 6) AS number FROM clean
""")
def mean_filled(spark, sf):
    df = dirty(spark, sf).select("event_id", coerce_double(F.col("raw")).alias("number"))
    return rounded(fill_mean(df, ["number"]))


@query("clean_inf", f"""
WITH {FLOWS}
SELECT row_id, CASE WHEN same_srv_rate = 0 THEN 0 ELSE round(src_bytes / same_srv_rate, 6) END AS ratio FROM flows
""")
def clean_inf(spark, sf):
    f = flows(spark, sf)
    rate = F.col("same_srv_rate")
    ratio = F.when(rate == 0, F.when(F.col("flag") == "SF", F.lit(float("inf"))).when(
        F.col("flag") == "S0", F.lit(float("-inf"))).otherwise(F.lit(float("nan")))).otherwise(F.col("src_bytes") / rate)
    return f.select("row_id", F.round(clean_infinite(ratio), 6).alias("ratio"))


@query("label_map", """
SELECT l_returnflag, l_linestatus, CASE l_returnflag WHEN 'A' THEN 'normal' WHEN 'R' THEN 'neptune' ELSE 'other' END AS labels,
  CASE l_linenumber WHEN 1 THEN 'icmp' WHEN 6 THEN 'tcp' ELSE 'tcp' END AS protocol_type,
  CASE l_linenumber WHEN 1 THEN 'S0' WHEN 2 THEN 'S1' WHEN 3 THEN 'S2' WHEN 4 THEN 'S3' WHEN 5 THEN 'OTH' ELSE 'SF' END AS flag,
  count(*) AS n FROM lineitem GROUP BY ALL
""")
def label_map(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return li.select(
        "l_returnflag", "l_linestatus",
        map_values(F.col("l_returnflag"), {"A": "normal", "R": "neptune"}, "other").alias("labels"),
        map_values(F.col("l_linenumber"), vocab.PROTOCOL_CODES, "tcp").alias("protocol_type"),
        map_values(F.col("l_linenumber"), vocab.CONNECTION_CODES, "SF").alias("flag"),
    ).groupBy("l_returnflag", "l_linestatus", "labels", "protocol_type", "flag").agg(F.count("*").alias("n"))


@query("label_map_join", f"""
WITH {FLOWS}
SELECT row_id, CASE labels WHEN 'normal' THEN 'BENIGN' WHEN 'neptune' THEN 'DoS' ELSE 'ATTACK' END AS named FROM flows
""")
def label_map_join(spark, sf):
    f = flows(spark, sf).select("row_id", "labels")
    return label_lookup(f, "labels", {"normal": "BENIGN", "neptune": "DoS"}, "ATTACK", "named").drop("labels")


@query("label_contains", f"""
WITH {CIC}
SELECT row_id, CASE WHEN trim(coalesce(label_text, '')) = 'BENIGN' THEN 0 ELSE 1 END AS label,
  CASE WHEN trim(coalesce(label_text, '')) = 'BENIGN' THEN 'Normal' WHEN label_text LIKE '%DoS%' THEN 'DoS'
    WHEN label_text LIKE '%PortScan%' THEN 'Reconnaissance' WHEN label_text LIKE '%Brute Force%' THEN 'BruteForce'
    WHEN label_text LIKE '%Heartbleed%' THEN 'Exploits' ELSE 'Other' END AS category
FROM cic
""")
def label_contains(spark, sf):
    df = cic_source(spark, sf)
    found = map_contains(F.col("` Label`"), vocab.CIC_LABEL_PARTS, ("BENIGN", "Normal"), "Other")
    return df.select("row_id", found.alias("x")).select("row_id", "x.label", "x.category")


@query("flag_classify", f"""
WITH {FLOWS}
SELECT row_id, CASE flag WHEN 'S0' THEN 'S1' WHEN 'REJ' THEN CASE WHEN protocol_type = 'view' THEN 'SF' ELSE 'S2' END
  ELSE 'SF' END AS state, CAST(flag = 'S0' AS INTEGER) AS syn FROM flows
""")
def flag_classify(spark, sf):
    f = flows(spark, sf)
    word = F.when(F.col("flag") == "SF", "0").when(F.col("flag") == "S0", "0x00000018").when(
        F.col("protocol_type") != "view", "0x00000014")
    return f.select("row_id", tcp_flag_state(word).alias("state"), flag_indicator(F.col("flag"), "S0").alias("syn"))


@query("label_binary", f"""
WITH {FLOWS}
SELECT row_id, CAST(labels <> 'normal' AS INTEGER) AS from_text, CAST(labels <> 'normal' AS INTEGER) AS from_number
FROM flows
""")
def label_binary(spark, sf):
    f = flows(spark, sf)
    text = F.concat(F.lit(" "), F.upper("labels"), F.lit(" "))
    number = F.when(F.col("labels") == "normal", "0").otherwise("1")
    return f.select("row_id", binary_label(text, "normal").alias("from_text"),
                    binary_label(number, "numeric").alias("from_number"))


@query("label_autodetect", """
SELECT o_orderkey, CAST(o_orderstatus <> (SELECT arg_min(o_orderstatus, o_orderkey) FROM orders) AS INTEGER) AS unknown,
  CAST(o_orderpriority <> '5-LOW' AS INTEGER) AS normal, CAST(o_orderstatus = 'F' AS INTEGER) AS numeric_text
FROM orders
""")
def label_autodetect(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.when(F.col("o_orderpriority") == "5-LOW", "Normal").otherwise(F.col("o_orderpriority")).alias("named"),
        (F.col("o_orderstatus") == "F").cast("int").cast("string").alias("text01"))
    rules = {c: detect_label_rule(o, c, "o_orderkey") for c in ("o_orderstatus", "named", "text01")}
    return o.select(
        "o_orderkey", binary_label(F.col("o_orderstatus"), rules["o_orderstatus"]).alias("unknown"),
        binary_label(F.col("named"), rules["named"]).alias("normal"),
        binary_label(F.col("text01"), rules["text01"]).alias("numeric_text"))


@query("derived_rates", f"""
WITH {FLOWS}
SELECT row_id, round((src_bytes + dst_bytes) / (duration + 1), 6) AS per_second,
  round(src_bytes / (same_srv_rate + 1), 6) AS per_packet,
  round((src_bytes + dst_bytes) / (duration + 0.000001), 2) AS rate FROM flows
""")
def derived_rates(spark, sf):
    f = flows(spark, sf)
    total = F.col("src_bytes") + F.col("dst_bytes")
    return f.select(
        "row_id", F.round(smoothed_ratio(total, F.col("duration"), 1.0), 6).alias("per_second"),
        F.round(smoothed_ratio(F.col("src_bytes"), F.col("same_srv_rate"), 1.0), 6).alias("per_packet"),
        F.round(smoothed_ratio(total, F.col("duration"), 1e-6), 2).alias("rate"))


@query("log1p_cols", f"""
WITH {FLOWS}
SELECT row_id, round(ln(1 + src_bytes), 6) AS src_bytes, round(ln(1 + greatest(src_bytes - 50, 0)), 6) AS shifted FROM flows
""")
def log1p_cols(spark, sf):
    f = flows(spark, sf)
    return f.select("row_id", F.round(log1p_clipped(F.col("src_bytes"), floor=False), 6).alias("src_bytes"),
                    F.round(log1p_clipped(F.col("src_bytes") - 50), 6).alias("shifted"))


@query("clip_fixed", f"""
WITH {FLOWS} SELECT row_id, least(greatest(src_bytes - 50, -10), 10) AS clipped FROM flows
""")
def clip_fixed(spark, sf):
    return flows(spark, sf).select("row_id", clip(F.col("src_bytes") - 50, -10.0, 10.0).alias("clipped"))


_PAIRS = [(a, b) for i, a in enumerate(("duration", "src_bytes", "dst_bytes", "same_srv_rate"))
          for b in ("duration", "src_bytes", "dst_bytes", "same_srv_rate")[i + 1:]]


@query("interactions", f"""
WITH {FLOWS}
SELECT row_id, {", ".join(f"{a} * {b} AS {a}_{b}_inter" for a, b in _PAIRS)} FROM flows
""")
def interaction_columns(spark, sf):
    cols = ["duration", "src_bytes", "dst_bytes", "same_srv_rate"]
    return interactions(flows(spark, sf).select("row_id", *cols), cols).drop(*cols)


@query("interactions_packed", f"""
WITH {FLOWS}
SELECT row_id, unnest([1, 2, 3, 4, 5, 6]) AS position, unnest([{", ".join(f"{a} * {b}" for a, b in _PAIRS)}]) AS product
FROM flows
""")
def interactions_packed(spark, sf):
    f = flows(spark, sf)
    packed = packed_products(["duration", "src_bytes", "dst_bytes", "same_srv_rate"])
    return f.select("row_id", F.posexplode(packed)).select(
        "row_id", (F.col("pos") + 1).alias("position"), F.col("col").alias("product"))


@query("attack_family", f"""
WITH {FLOWS}
SELECT row_id, CASE labels WHEN 'normal' THEN 'normal' WHEN 'neptune' THEN 'dos' ELSE 'probe' END AS family FROM flows
""")
def family(spark, sf):
    f = flows(spark, sf).select("row_id", "labels")
    return attack_family(f, "labels", vocab.family_pairs(vocab.KDD_FAMILIES)).drop("labels")


# --- unions -------------------------------------------------------------------------------

@query("union_all", """
SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem
""")
def stacked(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    li = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("v"), F.col("l_orderkey").alias("k"))
    return union_all([o, li])


@query("union_missing", """
SELECT o_orderkey AS k, o_totalprice AS price, CAST(NULL AS DOUBLE) AS balance FROM orders
UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer
""")
def missing(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    return union_all([o, c], allow_missing=True)


@query("source_tag", """
SELECT o_orderkey AS k, 'orders' AS source FROM orders UNION ALL SELECT l_orderkey, 'lineitem' FROM lineitem
""")
def tags_of_files(spark, sf):
    """Rows tagged with the name of the file that they come from."""
    tag = source_tag(suffix=".parquet").alias("source")
    return union_all([table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), tag),
                      table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), tag)])


@query("union_tagged", """
SELECT c_custkey AS k, c_acctbal AS v, 'customers' AS source FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, 'suppliers' FROM supplier
""")
def tagged(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return union_tagged({"customers": c, "suppliers": s})
