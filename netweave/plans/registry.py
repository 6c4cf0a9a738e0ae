"""The conversions between flow layouts, as data.

Fixed values: which source column stands for which target column.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from netweave.functions.labels import binary_label, flag_indicator, map_contains, map_values, tcp_flag_state
from netweave.functions.numeric import smoothed_ratio
from netweave.plans import vocab
from netweave.plans.mapping import KEEP, MappingSpec, Target, column
from netweave.plans.schemas import (
    CIC_COLUMNS,
    KDD_COLUMNS,
    KDD_TEXT,
    NB15_COLUMNS,
    NB15_TEXT,
    UNSW_RAW_COLUMNS,
    UNSW_RAW_TEXT,
)


def _lookup(mapping, default):
    return lambda c: map_values(c, mapping, default)


def _layout(columns, sources, special, text=(), text_default="unknown", pick="first", fill=None):
    """Targets in layout order: special ones as given, mapped ones, then defaults."""
    out = []
    for name in columns:
        if name in special:
            out.append(special[name])
        elif name in text:
            out.append(Target(name, sources.get(name, ()), text_default, kind="text", fill=fill, pick=pick))
        else:
            out.append(Target(name, sources.get(name, ()), fill=fill, pick=pick))
    return tuple(out)


# --- to the KDD layout ---------------------------------------------------------

_NB15_TO_KDD = {
    "duration": ("dur",), "src_bytes": ("sbytes",), "dst_bytes": ("dbytes",),
    "count": ("sttl",), "srv_count": ("dttl",), "serror_rate": ("sload",), "srv_serror_rate": ("dload",),
    "rerror_rate": ("sloss",), "srv_rerror_rate": ("dloss",), "same_srv_rate": ("sinpkt",),
    "diff_srv_rate": ("dinpkt",), "srv_diff_host_rate": ("sjit",), "dst_host_count": ("djit",),
    "dst_host_srv_count": ("swin",), "dst_host_same_srv_rate": ("dwin",),
    "dst_host_diff_srv_rate": ("stcpb",), "dst_host_same_src_port_rate": ("dtcpb",),
    "dst_host_srv_diff_host_rate": ("smeansz",), "dst_host_serror_rate": ("dmeansz",),
    "dst_host_srv_serror_rate": ("trans_depth",), "dst_host_rerror_rate": ("response_body_len",),
    "dst_host_srv_rerror_rate": ("ct_srv_src",),
}

_CIC_TO_KDD = {
    "duration": ("Flow Duration",), "src_bytes": ("Total Fwd Packets",), "dst_bytes": ("Total Backward Packets",),
    "wrong_fragment": ("Fwd Packets/s",), "count": ("Flow Packets/s",), "srv_count": ("Flow Bytes/s",),
    "serror_rate": ("Flow IAT Mean",), "srv_serror_rate": ("Flow IAT Std",), "rerror_rate": ("Flow IAT Max",),
    "srv_rerror_rate": ("Flow IAT Min",), "same_srv_rate": ("Fwd IAT Mean",), "diff_srv_rate": ("Fwd IAT Std",),
    "srv_diff_host_rate": ("Fwd IAT Max",), "dst_host_count": ("Bwd IAT Mean",),
    "dst_host_srv_count": ("Bwd IAT Std",), "dst_host_same_srv_rate": ("Bwd IAT Max",),
    "dst_host_diff_srv_rate": ("Bwd IAT Min",), "dst_host_same_src_port_rate": ("Active Mean",),
    "dst_host_srv_diff_host_rate": ("Active Std",), "dst_host_serror_rate": ("Active Max",),
    "dst_host_srv_serror_rate": ("Active Min",), "dst_host_rerror_rate": ("Idle Mean",),
    "dst_host_srv_rerror_rate": ("Idle Std",),
}

_MQTT_TO_KDD = {
    "duration": ("tcp.time_delta",), "src_bytes": ("tcp.len",), "dst_bytes": ("tcp.len",),
    "count": ("mqtt.len",), "srv_count": ("mqtt.msgid",), "serror_rate": ("mqtt.conack.flags",),
    "srv_serror_rate": ("mqtt.conack.flags.reserved",), "rerror_rate": ("mqtt.conack.flags.sp",),
    "srv_rerror_rate": ("mqtt.conack.val",), "same_srv_rate": ("mqtt.conflag.cleansess",),
    "diff_srv_rate": ("mqtt.conflag.passwd",), "srv_diff_host_rate": ("mqtt.conflag.qos",),
    "dst_host_count": ("mqtt.conflag.reserved",), "dst_host_srv_count": ("mqtt.conflag.retain",),
    "dst_host_same_srv_rate": ("mqtt.conflag.uname",), "dst_host_diff_srv_rate": ("mqtt.conflag.willflag",),
    "dst_host_same_src_port_rate": ("mqtt.conflags",), "dst_host_srv_diff_host_rate": ("mqtt.dupflag",),
    "dst_host_serror_rate": ("mqtt.hdrflags",), "dst_host_srv_serror_rate": ("mqtt.kalive",),
    "dst_host_rerror_rate": ("mqtt.msg",), "dst_host_srv_rerror_rate": ("mqtt.msgtype",),
}

_UKM_TO_KDD = {
    "duration": ("dur",), "src_bytes": ("src_byts",), "dst_bytes": ("dst_byts",), "count": ("src_pkts",),
    "srv_count": ("dst_pkts",), "serror_rate": ("flag_sign",), "srv_serror_rate": ("flag_synrst",),
    "rerror_rate": ("flag_arst",), "srv_rerror_rate": ("flag_uc",), "same_srv_rate": ("flag_a",),
    "diff_srv_rate": ("flag_othr",), "srv_diff_host_rate": ("no_lnkd",), "dst_host_count": ("dst_host_count",),
    "dst_host_srv_count": ("host_dst _count",), "dst_host_same_srv_rate": ("rtt_first_ack",),
    "dst_host_diff_srv_rate": ("rtt_avg",), "dst_host_same_src_port_rate": ("avg_t_sent",),
    "dst_host_srv_diff_host_rate": ("avg_t_got",), "dst_host_serror_rate": ("repeated",),
    "dst_host_srv_serror_rate": ("fst_src_sqc",), "dst_host_rerror_rate": ("fst_dst_sqc",),
    "dst_host_srv_rerror_rate": ("src_re",),
}


def _constant(name, value):
    return Target(name, (), value, kind="text" if isinstance(value, str) else "number")


nb15_to_kdd = MappingSpec(
    "nb15_to_kdd",
    _layout(KDD_COLUMNS, _NB15_TO_KDD, {
        "protocol_type": Target("protocol_type", ("proto",), "tcp", kind="text", fill=KEEP),
        "service": Target("service", ("service",), "http", kind="text", fill=KEEP),
        "flag": Target("flag", ("state",), "SF", kind="text", fill=KEEP),
        "labels": Target("labels", ("attack_cat",), "normal", kind="text",
                         make=_lookup(vocab.NB15_TO_KDD_LABELS, "normal")),
    }, fill=KEEP),
    label="attack_cat", known_labels=frozenset(vocab.NB15_TO_KDD_LABELS),
)

_cic_constants = {
    "protocol_type": _constant("protocol_type", "tcp"),
    "service": _constant("service", "http"),
    "flag": _constant("flag", "SF"),
}

cic_to_kdd = MappingSpec(
    "cic_to_kdd",
    _layout(KDD_COLUMNS, _CIC_TO_KDD, {
        **_cic_constants,
        "labels": Target("labels", ("Label",), "normal", kind="text",
                         make=_lookup(vocab.CIC_TO_KDD_LABELS, "normal")),
    }),
    label="Label", known_labels=frozenset(vocab.CIC_TO_KDD_LABELS),
)

cic_to_kdd_binary = MappingSpec(
    "cic_to_kdd_binary",
    _layout(KDD_COLUMNS, _CIC_TO_KDD, {
        **_cic_constants,
        "labels": Target("labels", ("Label",), "attack", kind="text",
                         make=_lookup({"BENIGN": "normal"}, "attack")),
    }),
    label="Label",
)

mqtt_to_kdd = MappingSpec(
    "mqtt_to_kdd",
    _layout(KDD_COLUMNS, _MQTT_TO_KDD, {
        "protocol_type": _constant("protocol_type", "tcp"),
        "service": _constant("service", "mqtt"),
        "flag": Target("flag", ("tcp.flags",), "SF", kind="text", make=tcp_flag_state),
        "labels": Target("labels", ("target",), "normal", kind="text",
                         make=_lookup(vocab.MQTT_TO_KDD_LABELS, "normal")),
    }),
    label="target", known_labels=frozenset(vocab.MQTT_TO_KDD_LABELS),
)

ukm_to_kdd = MappingSpec(
    "ukm_to_kdd",
    _layout(KDD_COLUMNS, _UKM_TO_KDD, {
        "protocol_type": Target("protocol_type", ("trnspt",), "tcp", kind="text",
                                make=lambda c: map_values(c.cast("int"), vocab.PROTOCOL_CODES, "tcp")),
        "service": Target("service", ("srvs",), "http", kind="text", fill="0"),
        "flag": Target("flag", ("flag_n",), "SF", kind="text",
                       make=lambda c: map_values(c.cast("int"), vocab.CONNECTION_CODES, "SF")),
        "labels": Target("labels", ("Class",), "normal", kind="text",
                         make=_lookup(vocab.UKM_TO_KDD_LABELS, "normal")),
    }),
    label="Class", known_labels=frozenset(vocab.UKM_TO_KDD_LABELS),
)

# Both label columns of this source are text; the target is named ``labels``.
bot_to_kdd = MappingSpec(
    "bot_to_kdd",
    _layout(KDD_COLUMNS, {c: (c,) for c in KDD_COLUMNS}, {
        **{c: Target(c, (c,), "0", kind="text") for c in KDD_TEXT},
        "labels": Target("labels", ("category", "attack"), "attack", kind="text",
                         make=lambda c: F.when(binary_label(c, "normal") == 0, "normal").otherwise("attack")),
    }),
    label="category",
)

# --- to the NB15 layout --------------------------------------------------------

_CIC_TO_NB15 = {
    "dur": ("Flow Duration",), "spkts": ("Total Fwd Packets",), "dpkts": ("Total Backward Packets",),
    "sbytes": ("Total Length of Fwd Packets",), "dbytes": ("Total Length of Bwd Packets",),
    "smean": ("Fwd Packet Length Mean",), "dmean": ("Bwd Packet Length Mean",), "rate": ("Flow Bytes/s",),
    "sinpkt": ("Flow IAT Mean", "Fwd IAT Mean"), "dinpkt": ("Bwd IAT Mean",), "sjit": ("Fwd IAT Std",),
    "djit": ("Bwd IAT Std",), "swin": ("Fwd Header Length", "Init_Win_bytes_forward"),
    "dwin": ("Bwd Header Length", "Init_Win_bytes_backward"), "stcpb": ("Fwd Avg Bytes/Bulk",),
    "dtcpb": ("Bwd Avg Bytes/Bulk",), "tcprtt": ("Active Mean",), "synack": ("Idle Mean",),
}


def _cic_category(parts, trim):
    return partial(map_contains, ordered=parts, exact=("BENIGN", "Normal"), default="Other", trim=trim)


def _cic_labels(parts, trim=True):
    find = _cic_category(parts, trim)
    return {
        "label": Target("label", ("Label",), 1, make=lambda c: find(c)["label"].cast("double")),
        "attack_cat": Target("attack_cat", ("Label",), "Unknown", kind="text",
                             make=lambda c: find(c)["category"]),
    }


def _flow_rate():
    return F.coalesce(smoothed_ratio(column("sbytes") + column("dbytes"), column("dur"), 1e-6), F.lit(0.0))


cic_to_nb15 = MappingSpec(
    "cic_to_nb15",
    _layout(NB15_COLUMNS, _CIC_TO_NB15, _cic_labels(vocab.CIC_LABEL_PARTS), NB15_TEXT, pick="last"),
    derived=(("rate", _flow_rate),),
    label="Label", sequence="id",
)

# The option that also fills what the source cannot tell from the mapped columns.
cic_to_nb15_derived = MappingSpec(
    "cic_to_nb15_derived",
    cic_to_nb15.targets,
    derived=(
        ("rate", _flow_rate),
        ("sttl", lambda: F.lit(64.0)),
        ("dttl", lambda: F.lit(64.0)),
        ("sload", lambda: F.coalesce(smoothed_ratio(column("sbytes"), column("dur"), 1e-6), F.lit(0.0))),
        ("dload", lambda: F.coalesce(smoothed_ratio(column("dbytes"), column("dur"), 1e-6), F.lit(0.0))),
    ),
    label="Label", sequence="id",
)

_CIC_TO_NB15_DIRECT = {
    "dur": ("Flow Duration",), "spkts": ("Total Fwd Packets",), "dpkts": ("Total Backward Packets",),
    "sbytes": ("Total Fwd Bytes",), "dbytes": ("Total Backward Bytes",),
    "smean": ("Fwd Packet Length Mean",), "dmean": ("Bwd Packet Length Mean",),
}

cic_to_nb15_direct = MappingSpec(
    "cic_to_nb15_direct",
    _layout(NB15_COLUMNS, {c: (c,) + _CIC_TO_NB15_DIRECT.get(c, ()) for c in NB15_COLUMNS},
            _cic_labels(vocab.CIC_LABEL_PARTS_SHORT, trim=False), ("proto", "service", "state"), "0"),
    label="Label",
)

cic_to_nb15_minimal = MappingSpec(
    "cic_to_nb15_minimal",
    (
        Target("dur", ("Flow Duration",), kind="raw"),
        Target("sbytes", ("Total Fwd Packets",), kind="raw"),
        Target("dbytes", ("Total Backward Packets",), kind="raw"),
        *_cic_labels(vocab.CIC_LABEL_PARTS_SHORT, trim=False).values(),
    ),
    present_only=True, label="Label",
)

# Candidate names per target: the first that exists is taken.
_UKM_TO_NB15 = {
    "dur": ("dur", "duration", "time"), "proto": ("proto", "protocol", "trnspt"),
    "service": ("service", "srvs", "app"), "state": ("state", "conn_state"),
    "spkts": ("spkts", "src_pkts", "source_packets"), "dpkts": ("dpkts", "dst_pkts", "dest_packets"),
    "sbytes": ("sbytes", "src_bytes", "source_bytes"), "dbytes": ("dbytes", "dst_bytes", "dest_bytes"),
    "sttl": ("sttl", "src_ttl", "source_ttl"), "dttl": ("dttl", "dst_ttl", "dest_ttl"),
    "sload": ("sload", "src_load", "source_load"), "dload": ("dload", "dst_load", "dest_load"),
    "sloss": ("sloss", "src_loss", "source_loss"), "dloss": ("dloss", "dst_loss", "dest_loss"),
    "sinpkt": ("sinpkt", "src_inpkt", "source_inpkt"), "dinpkt": ("dinpkt", "dst_inpkt", "dest_inpkt"),
    "sjit": ("sjit", "src_jit", "source_jit"), "djit": ("djit", "dst_jit", "dest_jit"),
    "swin": ("swin", "src_win", "source_win"), "stcpb": ("stcpb", "src_tcpb", "source_tcpb"),
    "dtcpb": ("dtcpb", "dst_tcpb", "dest_tcpb"), "dwin": ("dwin", "dst_win", "dest_win"),
    "tcprtt": ("tcprtt", "tcp_rtt"), "synack": ("synack", "syn_ack"), "ackdat": ("ackdat", "ack_data"),
    "smean": ("smean", "src_mean", "source_mean"), "dmean": ("dmean", "dst_mean", "dest_mean"),
    "trans_depth": ("trans_depth", "transaction_depth"),
    "response_body_len": ("response_body_len", "resp_body_len"),
    "ct_srv_src": ("ct_srv_src", "service_src_count"), "ct_state_ttl": ("ct_state_ttl", "state_ttl_count"),
    "ct_dst_ltm": ("ct_dst_ltm", "dst_host_count"), "ct_src_dport_ltm": ("ct_src_dport_ltm", "src_dport_count"),
    "ct_dst_sport_ltm": ("ct_dst_sport_ltm", "dst_sport_count"),
    "ct_dst_src_ltm": ("ct_dst_src_ltm", "dst_src_count"), "is_ftp_login": ("is_ftp_login", "ftp_login"),
    "ct_ftp_cmd": ("ct_ftp_cmd", "ftp_cmd_count"),
    "ct_flw_http_mthd": ("ct_flw_http_mthd", "http_method_count"),
    "ct_src_ltm": ("ct_src_ltm", "src_host_count"), "ct_srv_dst": ("ct_srv_dst", "service_dst_count"),
    "is_sm_ips_ports": ("is_sm_ips_ports", "same_ip_port"),
    "label": ("label", "Binary", "binary", "is_attack"),
    "attack_cat": ("attack_cat", "Class", "attack_type", "attack_category"),
}


def _per_second():
    return smoothed_ratio(column("sbytes") + column("dbytes"), column("dur"), 1.0)


ukm_to_nb15 = MappingSpec(
    "ukm_to_nb15",
    tuple(
        Target(name, names, "normal" if name == "attack_cat" else "unknown", kind="text", fill=KEEP)
        if name in NB15_TEXT else Target(name, names, fill=KEEP)
        for name, names in _UKM_TO_NB15.items()
    ),
    derived=(
        ("rate", _per_second),
        ("src_avg_byts", lambda: smoothed_ratio(column("sbytes"), column("spkts"), 1.0)),
        ("dst_avg_byts", lambda: smoothed_ratio(column("dbytes"), column("dpkts"), 1.0)),
    ),
    label="Class", sequence="id",
)

_UKM_TO_NSL = {
    "dur": "duration", "trnspt": "protocol_type", "srvs": "service", "flag_n": "flag",
    "flag_arst": "src_bytes", "flag_uc": "dst_bytes", "flag_sign": "land", "flag_synrst": "wrong_fragment",
    "flag_a": "urgent", "flag_othr": "hot", "src_pkts": "num_failed_logins", "dst_pkts": "logged_in",
    "urg_bits": "num_compromised", "push_pkts": "root_shell", "no_lnkd": "su_attempted", "arp": "num_root",
    "src_ttl": "num_file_creations", "dst_ttl": "num_shells", "pkts_dirctn": "num_access_files",
    "src_byts": "num_outbound_cmds", "dst_byts": "is_host_login", "src_avg_byts": "is_guest_login",
    "dst_avg_byts": "count", "strt_t": "srv_count", "end_t": "serror_rate",
    "dst_host_count": "srv_serror_rate", "host_dst _count": "rerror_rate", "rtt_first_ack": "srv_rerror_rate",
    "rtt_avg": "same_srv_rate", "avg_t_sent": "diff_srv_rate", "avg_t_got": "srv_diff_host_rate",
    "repeated": "dst_host_same_srv_rate", "fst_src_sqc": "dst_host_diff_srv_rate",
    "fst_dst_sqc": "dst_host_same_src_port_rate", "src_re": "dst_host_srv_diff_host_rate",
    "dst_re": "dst_host_serror_rate", "src_fast_re": "dst_host_srv_serror_rate",
    "dst_fast_re": "dst_host_rerror_rate", "ovrlp_count": "dst_host_srv_rerror_rate",
    "Class": "labels", "Binary": "label_binary",
}

_UKM_NSL_TEXT = ("service", "labels")

ukm_to_nsl = MappingSpec(
    "ukm_to_nsl",
    tuple(
        Target(target, (source,), "0" if target in _UKM_NSL_TEXT else 0,
               kind="text" if target in _UKM_NSL_TEXT else "number")
        for source, target in _UKM_TO_NSL.items()
    ),
    keep_rest=True, present_only=True, label="Class",
)

nsl_to_nb15 = MappingSpec(
    "nsl_to_nb15",
    _layout([c for c in NB15_COLUMNS if c not in ("id", "sload", "dload")], {
        "dur": ("duration",), "sbytes": ("src_bytes",), "dbytes": ("dst_bytes",), "sloss": ("wrong_fragment",),
        "dloss": ("urgent",), "proto": ("protocol_type",), "service": ("service",), "state": ("flag",),
    }, {
        "attack_cat": Target("attack_cat", ("attack_type",), "normal", kind="text", fill=KEEP),
        "label": Target("label", ("label",), 1,
                        make=lambda c: F.coalesce((c.cast("string") != "normal").cast("double"), F.lit(1.0))),
    }, NB15_TEXT, fill=KEEP),
    derived=(
        ("rate", _per_second),
        ("sinpkt", lambda: smoothed_ratio(column("sbytes"), column("spkts"), 1.0)),
        ("dinpkt", lambda: smoothed_ratio(column("dbytes"), column("dpkts"), 1.0)),
    ),
    label="label", sequence="id",
)

# --- CTU sources ---------------------------------------------------------------

_CTU_TO_UNSW = {
    "dur": ("Flow Duration",), "sbytes": ("TotLen Fwd Pkts",), "dbytes": ("TotLen Bwd Pkts",),
    "Sload": ("Flow Byts/s",), "Spkts": ("Tot Fwd Pkts",), "Dpkts": ("Tot Bwd Pkts",),
    "smeansz": ("Fwd Pkt Len Mean",), "dmeansz": ("Bwd Pkt Len Mean",), "Sintpkt": ("Flow IAT Mean",),
    "Dintpkt": ("Bwd IAT Mean",), "Label": ("Label",),
}


def _ctu_category(name):
    return lambda c: F.when(c.try_cast("double") == 0.0, "Normal").otherwise(name)


_UNSW_ZERO = (
    "is_sm_ips_ports", "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd", "ct_srv_src",
    "ct_srv_dst", "ct_dst_ltm", "ct_src_ ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
)

# Measures that the source lacks stay empty; only the counters above become 0.
ctu_to_unsw = MappingSpec(
    "ctu_to_unsw",
    _layout(UNSW_RAW_COLUMNS, _CTU_TO_UNSW, {
        **{c: Target(c, (), None) for c in UNSW_RAW_COLUMNS
           if c not in UNSW_RAW_TEXT and c not in _UNSW_ZERO and c not in _CTU_TO_UNSW},
        "attack_cat": Target("attack_cat", ("Label",), "Attack", kind="text", make=_ctu_category("Attack")),
    }, UNSW_RAW_TEXT, text_default="", fill=KEEP),
    label="Label",
)

# One source column may feed several targets.
_CTU_TO_NB15 = {
    "id": "Flow ID", "dur": "Flow Duration", "proto": "Protocol", "service": "Service", "state": "State",
    "spkts": "Tot Fwd Pkts", "dpkts": "Tot Bwd Pkts", "sbytes": "TotLen Fwd Pkts", "dbytes": "TotLen Bwd Pkts",
    "rate": "Flow Byts/s", "sttl": "Fwd Header Len", "dttl": "Bwd Header Len", "sload": "Fwd Seg Size Avg",
    "dload": "Bwd Seg Size Avg", "sloss": "Fwd Seg Size Min", "dloss": "Bwd Seg Size Min",
    "sinpkt": "Fwd IAT Min", "dinpkt": "Bwd IAT Min", "sjit": "Fwd IAT Std", "djit": "Bwd IAT Std",
    "swin": "Init Fwd Win Byts", "stcpb": "Fwd Act Data Pkts", "dtcpb": "Bwd Act Data Pkts",
    "dwin": "Init Bwd Win Byts", "tcprtt": "Flow IAT Mean", "synack": "Fwd IAT Mean", "ackdat": "Bwd IAT Mean",
    "smean": "Fwd Pkt Len Mean", "dmean": "Bwd Pkt Len Mean", "trans_depth": "Fwd Pkt Len Max",
    "response_body_len": "Fwd Pkt Len Min", "ct_srv_src": "Flow Duration", "ct_state_ttl": "TotLen Fwd Pkts",
    "ct_dst_ltm": "Fwd Header Len", "ct_src_dport_ltm": "Bwd Header Len", "ct_dst_sport_ltm": "Fwd Seg Size Avg",
    "ct_dst_src_ltm": "Bwd Seg Size Avg", "is_ftp_login": "Fwd PSH Flags", "ct_ftp_cmd": "Bwd PSH Flags",
    "ct_flw_http_mthd": "Fwd URG Flags", "ct_src_ltm": "Bwd URG Flags", "ct_srv_dst": "Active Mean",
    "is_sm_ips_ports": "Idle Mean",
}

ctu_to_nb15 = MappingSpec(
    "ctu_to_nb15",
    tuple(
        Target(name, (source,), "-1", kind="text") if name in ("id", "proto", "service", "state")
        else Target(name, (source,), -1)
        for name, source in _CTU_TO_NB15.items()
    ) + (
        Target("attack_cat", ("Label",), "Normal", kind="text",
               make=lambda c: F.when(c.try_cast("double") == 1.0, "Bot").otherwise("Normal")),
        Target("label", ("Label",), 0,
               make=lambda c: F.when(c.try_cast("double") == 1.0, 1.0).otherwise(0.0)),
    ),
    label="Label",
)

# --- to the CIC layout ---------------------------------------------------------

_KDD_TO_CIC = {
    "Flow Duration": ("duration",), "Total Fwd Packets": ("src_bytes",), "Total Backward Packets": ("dst_bytes",),
    "Fwd Packets/s": ("wrong_fragment",), "Flow Packets/s": ("count",), "Flow Bytes/s": ("srv_count",),
    "Flow IAT Mean": ("serror_rate",), "Flow IAT Std": ("srv_serror_rate",), "Flow IAT Max": ("rerror_rate",),
    "Flow IAT Min": ("srv_rerror_rate",), "Fwd IAT Mean": ("same_srv_rate",), "Fwd IAT Std": ("diff_srv_rate",),
    "Fwd IAT Max": ("srv_diff_host_rate",), "Bwd IAT Mean": ("dst_host_count",),
    "Bwd IAT Std": ("dst_host_srv_count",), "Bwd IAT Max": ("dst_host_same_srv_rate",),
    "Bwd IAT Min": ("dst_host_diff_srv_rate",), "Active Mean": ("dst_host_same_src_port_rate",),
    "Active Std": ("dst_host_srv_diff_host_rate",), "Active Max": ("dst_host_serror_rate",),
    "Active Min": ("dst_host_srv_serror_rate",), "Idle Mean": ("dst_host_rerror_rate",),
    "Idle Std": ("dst_host_srv_rerror_rate",), "URG Flag Count": ("urgent",),
}


def _flag_count(name, value):
    return Target(name, ("flag",), 0, make=lambda c: flag_indicator(c, value).cast("double"))


kdd_to_cic = MappingSpec(
    "kdd_to_cic",
    _layout(CIC_COLUMNS, _KDD_TO_CIC, {
        "Fwd PSH Flags": _flag_count("Fwd PSH Flags", "PSH"),
        "SYN Flag Count": _flag_count("SYN Flag Count", "SYN"),
        "RST Flag Count": _flag_count("RST Flag Count", "RST"),
        "ACK Flag Count": _flag_count("ACK Flag Count", "ACK"),
        "Label": Target("Label", ("labels",), "ATTACK", kind="text",
                        make=_lookup(vocab.KDD_TO_CIC_LABELS, "ATTACK")),
    }),
    label="labels", known_labels=frozenset(vocab.KDD_TO_CIC_LABELS),
)

SPECS = {
    spec.name: spec
    for spec in (
        nb15_to_kdd, cic_to_kdd, cic_to_kdd_binary, mqtt_to_kdd, ukm_to_kdd, bot_to_kdd,
        cic_to_nb15, cic_to_nb15_derived, cic_to_nb15_direct, cic_to_nb15_minimal,
        ukm_to_nb15, ukm_to_nsl, nsl_to_nb15, ctu_to_unsw, ctu_to_nb15, kdd_to_cic,
    )
}
