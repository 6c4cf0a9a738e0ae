"""Counts, reports, samples and power laws."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.checks.base import (
    FLOWS,
    LABELLED,
    PACKETS,
    flows,
    hash_sql,
    labelled,
    packets,
    query,
    rounded,
    table,
    unit_sql,
)
from netweave.functions import unit_hash
from netweave.operators import profile
from netweave.operators.flows import assemble_flows, to_nb15
from netweave.operators.powerlaw import compare_tails, fit_power_law
from netweave.operators.quantiles import quantiles
from netweave.operators.sampling import (
    sample_fraction,
    sample_quota,
    split_random,
    split_stratified,
    with_fold,
)
from netweave.operators.state import add_parts, merged_profile
from netweave.plans import vocab
from netweave.plans.schemas import KDD_FEATURE_GROUPS, NB15_FEATURE_GROUPS
from netweave.session import scratch_path, small_table

# --- counts ------------------------------------------------------------------------


@query("class_counts", f"WITH {FLOWS} SELECT labels, count(*) AS n FROM flows GROUP BY 1")
def class_counts(spark, sf):
    return profile.class_counts(flows(spark, sf), "labels")


@query("class_share", """
SELECT l_returnflag, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM lineitem GROUP BY 1
""")
def class_share(spark, sf):
    return rounded(profile.class_share(table(spark, sf, "lineitem"), "l_returnflag"))


def gappy(spark, sf):
    """Flows with missing cells."""
    f = flows(spark, sf)
    return f.select(
        "row_id", "duration", F.when(F.col("flag") != "SF", F.col("src_bytes")).alias("src_bytes"),
        F.when(F.col("protocol_type") == "view", F.lit(float("nan"))).otherwise(F.col("same_srv_rate")).alias("same_srv_rate"),
        F.when(F.col("labels") != "satan", F.col("flag")).alias("flag"))


@query("null_counts", f"""
WITH {FLOWS}
SELECT 'row_id' AS feature, 0 AS nulls UNION ALL SELECT 'duration', 0
UNION ALL SELECT 'src_bytes', count(*) FILTER (flag = 'SF') FROM flows
UNION ALL SELECT 'same_srv_rate', count(*) FILTER (protocol_type = 'view') FROM flows
UNION ALL SELECT 'flag', count(*) FILTER (labels = 'satan') FROM flows
""")
def null_counts(spark, sf):
    return profile.null_counts(gappy(spark, sf))


_DESCRIBED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _describe_sql(c, source="lineitem"):
    return f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS lower, round(median({c}), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS upper, round(max({c}), 4) AS max FROM {source}"""


@query("describe_numeric", " UNION ALL ".join(_describe_sql(c) for c in _DESCRIBED))
def describe_numeric(spark, sf):
    return rounded(profile.describe(table(spark, sf, "lineitem").select(*_DESCRIBED)), 4)


@query("describe_narrowed", " UNION ALL ".join(_describe_sql(c) for c in _DESCRIBED[:2]))
def describe_narrowed(spark, sf):
    """The same summary through the narrowing passes used for columns of any size."""
    li = table(spark, sf, "lineitem").select(*_DESCRIBED[:2])
    return rounded(profile.describe(li, small=0), 4)


def _merged_sql(c):
    return f"""SELECT '{c}' AS feature, count({c}) AS n, count(*) - count({c}) AS nulls, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS low, round(max({c}), 4) AS high, true AS distinct_near, true AS median_near
FROM lineitem"""


@query("profile_merged", " UNION ALL ".join(_merged_sql(c) for c in ("l_quantity", "l_extendedprice", "l_partkey")))
def profile_merged(spark, sf):
    """The profile of line items merged from states of their return flags, added one after the other.

    What SQL can say of the sketches is that they are near the exact figures.
    """
    cols = ["l_quantity", "l_extendedprice", "l_partkey"]
    li = table(spark, sf, "lineitem").select("l_returnflag", *cols)
    path = scratch_path(spark, "profile-state")
    for flag in ("A", "N", "R"):
        kept = add_parts(spark, path, li.where(F.col("l_returnflag") == flag), "l_returnflag", cols)
    exact = li.agg(*[F.count_distinct(c).alias(c) for c in cols]).first()
    ranks = {c: li.agg(F.count(c)).first()[0] for c in cols}
    merged = merged_profile(kept)
    middle = {r["feature"]: r["quantiles"][1] for r in merged.collect()}
    below = li.agg(*[F.count_if(F.col(c) < middle[c]).alias(f"{c}_lt") for c in cols],
                   *[F.count_if(F.col(c) <= middle[c]).alias(f"{c}_le") for c in cols]).first()

    def per_column(values):
        out = F.lit(None)
        for c, v in values.items():
            out = F.when(F.col("feature") == c, F.lit(v)).otherwise(out)
        return out

    near = {c: below[f"{c}_lt"] <= 0.53 * ranks[c] and below[f"{c}_le"] >= 0.47 * ranks[c] for c in cols}
    return rounded(merged.select(
        "feature", "n", "nulls", "mean", "std", "low", "high",
        (F.abs(F.col("distinct") - per_column({c: exact[c] for c in cols})) <= 0.08 * F.col("distinct") + 1).alias("distinct_near"),
        per_column(near).alias("median_near")), 4)


@query("distinct_counts", """
SELECT 'l_returnflag' AS feature, count(DISTINCT l_returnflag) AS "distinct" FROM lineitem
UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem
UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem
""")
def distinct_counts(spark, sf):
    return profile.distinct_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_suppkey", "l_partkey"])


def _histogram_sql(bins):
    return f"""
WITH {LABELLED}, ends AS (SELECT min(src_bytes) AS lo, (max(src_bytes) - min(src_bytes)) / {bins} AS width FROM labelled),
b AS (SELECT CAST(least(floor((src_bytes - lo) / width), {bins - 1}) AS INTEGER) AS bin, label, count(*) AS n
  FROM labelled, ends GROUP BY 1, 2),
every AS (SELECT label, total, CAST(bin AS INTEGER) AS bin
  FROM (SELECT label, count(*) AS total FROM labelled GROUP BY 1), range({bins}) AS r(bin))
SELECT label, bin, round(lo + bin * width, 6) AS low, round(lo + (bin + 1) * width, 6) AS high, coalesce(n, 0) AS n,
  round(coalesce(n, 0) / total / width, 8) AS density FROM every LEFT JOIN b USING (label, bin), ends
"""


@query("histogram", _histogram_sql(30))
def histogram(spark, sf):
    out = profile.histogram(labelled(spark, sf), "src_bytes", 30, ["label"])
    return out.withColumns({"low": F.round("low", 6), "high": F.round("high", 6), "density": F.round("density", 8)})


_EDGED = """
  SELECT CASE WHEN l_returnflag = 'A' THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS gaps,
    CASE WHEN l_linenumber = 6 THEN CAST('Infinity' AS DOUBLE) WHEN l_linenumber = 7 THEN CAST('-Infinity' AS DOUBLE)
      ELSE CAST(l_extendedprice AS DOUBLE) END AS ends, CAST(7 AS DOUBLE) AS same,
    CASE WHEN l_orderkey = 1 THEN CAST(9007199254740992 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END AS spike FROM lineitem"""


@query("quantiles_edge", f"""
WITH e AS ({_EDGED}), long AS (UNPIVOT e ON gaps, ends, same, spike INTO NAME feature VALUE v)
SELECT feature, unnest([CAST(0.25 AS DOUBLE), 0.5, 0.75]) AS p, unnest(list_transform(quantile_cont(v, [0.25, 0.5, 0.75]), lambda x: round(x, 6))) AS value
FROM long WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY feature
""")
def quantiles_edge(spark, sf):
    """Undefined, infinite and constant values on the way that large tables take."""
    table(spark, sf, "lineitem").createOrReplaceTempView("_quantile_edges")
    df = spark.sql(_EDGED.replace("FROM lineitem", "FROM _quantile_edges"))
    probs = [0.25, 0.5, 0.75]
    q = quantiles(df, df.columns, probs, small=0)
    rows = [(c, p, v) for c in df.columns for p, v in zip(probs, q[c])]
    return rounded(small_table(spark, rows, "feature string, p double, value double"))


# --- reports -----------------------------------------------------------------------

def sourced(spark, sf):
    """Flows split into train and test tables; one class is absent from the test part."""
    f = labelled(spark, sf)
    part = F.when((F.col("labels") != "satan") & (unit_hash("row_id", seed=7) < 0.3), "test").otherwise("train")
    return f.withColumn("source", part)


SOURCED = LABELLED + f""", sourced AS (
  SELECT *, CASE WHEN labels <> 'satan' AND {unit_sql(seed=7)} < 0.3 THEN 'test' ELSE 'train' END AS source FROM labelled)"""


@query("class_summary", f"""
WITH {SOURCED}
SELECT labels, count(*) FILTER (source = 'test') AS test_rows, count(*) FILTER (source <> 'test') AS train_rows,
  count(*) AS rows, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent,
  printf('%.2f%%', 100.0::DOUBLE * count(*) / sum(count(*)) OVER ()) AS percent_text,
  CASE labels WHEN 'normal' THEN 'normal' WHEN 'neptune' THEN 'dos' ELSE 'probe' END AS family
FROM sourced GROUP BY labels
""")
def class_summary(spark, sf):
    return rounded(profile.class_summary(sourced(spark, sf), "labels", "source", vocab.family_pairs(vocab.KDD_FAMILIES)))


GROUPS = KDD_FEATURE_GROUPS


def _profile_sql(source):
    numeric = " UNION ALL ".join(f"""
SELECT labels, rows, '{f}' AS feature, round(100.0::DOUBLE * used / rows, 6) AS usage,
  CASE WHEN used = 0 THEN 0 ELSE round(lo, 6) END AS min, CASE WHEN used = 0 THEN 0 ELSE round(hi, 6) END AS max,
  CASE WHEN used = 0 THEN 0 ELSE round(mid, 6) END AS mean, CASE WHEN used = 0 THEN 'unused' ELSE 'used' END AS note,
  '{g}' AS category FROM (SELECT labels, count(*) AS rows, count(*) FILTER ({f} <> 0) AS used,
    min({f}) AS lo, max({f}) AS hi, avg({f}) AS mid FROM {source} GROUP BY labels)"""
        for f, g in (("duration", "basic"), ("src_bytes", "basic"), ("dst_bytes", "basic"), ("same_srv_rate", "traffic"),
                     ("land", "basic")))
    text = " UNION ALL ".join(f"""
SELECT labels, count(*), '{f}', 100.0, NULL, NULL, NULL, 'values: ' || CASE WHEN length(string_agg(DISTINCT {f}, ', ' ORDER BY {f})) > 50
    THEN substr(string_agg(DISTINCT {f}, ', ' ORDER BY {f}), 1, 50) || '...' ELSE string_agg(DISTINCT {f}, ', ' ORDER BY {f}) END, 'basic'
FROM {source} GROUP BY labels""" for f in ("protocol_type", "flag"))
    return numeric + " UNION ALL " + text


@query("profile_by_class", f"WITH {LABELLED}, p AS (SELECT *, 0 AS land FROM labelled) {_profile_sql('p')}")
def profile_by_class(spark, sf):
    df = labelled(spark, sf).withColumn("land", F.lit(0))
    return rounded(profile.profile_by_class(df, "labels", GROUPS, max_chars=50))


@query("profile_fallback", f"""
WITH {SOURCED}, p AS (
  SELECT *, 0 AS land FROM sourced WHERE source = 'test' OR labels NOT IN (SELECT labels FROM sourced WHERE source = 'test'))
{_profile_sql('p')}
""")
def profile_fallback(spark, sf):
    df = sourced(spark, sf).withColumn("land", F.lit(0))
    return rounded(profile.profile_by_class(df, "labels", GROUPS, source="source", fallback="test", max_chars=50))


@query("profile_counts", f"""
WITH {FLOWS}
SELECT labels, count(*) AS rows, 'user' AS feature, 100.0::DOUBLE AS usage, NULL::DOUBLE AS min, NULL::DOUBLE AS max,
  NULL::DOUBLE AS mean, 'distinct: ' || count(DISTINCT user_id) AS note, 'who' AS category FROM flows GROUP BY labels
""")
def profile_counts(spark, sf):
    df = flows(spark, sf).withColumn("user", F.col("user_id").cast("string"))
    return profile.profile_by_class(df, "labels", {"who": ("user",)}, text_as="count")


_NB15_FLOWS = FLOWS + """, nb AS (SELECT labels AS attack_cat, duration AS dur, protocol_type AS proto, flag AS state,
  src_bytes AS sbytes, dst_bytes AS dbytes, 0 AS is_ftp_login FROM flows)"""


@query("profile_nb15", f"""
WITH {_NB15_FLOWS} {" UNION ALL ".join(f"""
SELECT attack_cat, rows, '{f}' AS feature, round(100.0::DOUBLE * used / rows, 6) AS usage,
  CASE WHEN used = 0 THEN 0 ELSE round(lo, 6) END AS min, CASE WHEN used = 0 THEN 0 ELSE round(hi, 6) END AS max,
  CASE WHEN used = 0 THEN 0 ELSE round(mid, 6) END AS mean, CASE WHEN used = 0 THEN 'unused' ELSE 'used' END AS note,
  '{g}' AS category FROM (SELECT attack_cat, count(*) AS rows, count(*) FILTER ({f} <> 0) AS used,
    min({f}) AS lo, max({f}) AS hi, avg({f}) AS mid FROM nb GROUP BY attack_cat)"""
    for f, g in (("dur", "basic"), ("sbytes", "traffic"), ("dbytes", "traffic"), ("is_ftp_login", "protocol")))}
{"".join(f"""
UNION ALL SELECT attack_cat, count(*), '{f}', 100.0, NULL, NULL, NULL, 'values: ' || string_agg(DISTINCT {f}, ', ' ORDER BY {f}), 'basic'
FROM nb GROUP BY attack_cat""" for f in ("proto", "state"))}
""")
def profile_nb15(spark, sf):
    """The groups of the 49-column layout, values listed whole."""
    f = flows(spark, sf)
    nb = f.select(F.col("labels").alias("attack_cat"), F.col("duration").alias("dur"), F.col("protocol_type").alias("proto"),
                  F.col("flag").alias("state"), F.col("src_bytes").alias("sbytes"), F.col("dst_bytes").alias("dbytes"),
                  F.lit(0).alias("is_ftp_login"))
    return rounded(profile.profile_by_class(nb, "attack_cat", NB15_FEATURE_GROUPS))


def named(spark, sf):
    """NB15-style category and a label that is wrong for one group."""
    f = labelled(spark, sf)
    return f.select(
        "duration", F.when(F.col("flag") != "SF", F.col("src_bytes")).alias("sbytes"), "protocol_type",
        F.when(F.col("labels") == "normal", "Normal").otherwise(F.initcap("labels")).alias("attack_cat"),
        F.when((F.col("labels") == "satan") & (F.col("flag") == "S0"), 0).otherwise(F.col("label")).alias("label"))


NAMED = LABELLED + """, named AS (
  SELECT duration, CASE WHEN flag <> 'SF' THEN src_bytes END AS sbytes, protocol_type,
    CASE labels WHEN 'normal' THEN 'Normal' WHEN 'neptune' THEN 'Neptune' ELSE 'Satan' END AS attack_cat,
    CASE WHEN labels = 'satan' AND flag = 'S0' THEN 0 ELSE label END AS label FROM labelled)"""


@query("verify_labels", f"""
WITH {NAMED}
SELECT count(*) FILTER (attack_cat = 'Normal' AND label = 0) AS normal_as_0,
  count(*) FILTER (attack_cat <> 'Normal' AND label = 1) AS attack_as_1, count(*) AS rows,
  round(count(*) FILTER ((attack_cat = 'Normal') = (label = 0)) / count(*), 6) AS accuracy FROM named
""")
def verify_labels(spark, sf):
    return rounded(profile.label_consistency(named(spark, sf), "label", "attack_cat"))


@query("verify_report", f"""
WITH {NAMED}, ok AS (
  SELECT count(*)::DOUBLE AS n, count(*) FILTER (attack_cat = 'Normal' AND label = 0)::DOUBLE AS a,
    count(*) FILTER (attack_cat <> 'Normal' AND label = 1)::DOUBLE AS b FROM named)
SELECT 'shape' AS section, 'columns' AS item, 5.0::DOUBLE AS value, NULL::DOUBLE AS percent
UNION ALL SELECT 'types', 'numeric', 3, NULL UNION ALL SELECT 'types', 'text', 2, NULL
UNION ALL SELECT 'shape', 'rows', n, NULL FROM ok
UNION ALL SELECT 'labels', 'normal as 0', a, NULL FROM ok UNION ALL SELECT 'labels', 'attack as 1', b, NULL FROM ok
UNION ALL SELECT 'labels', 'consistent', a + b, round(100 * (a + b) / n, 6) FROM ok
UNION ALL SELECT 'label', label::VARCHAR, count(*), round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) FROM named GROUP BY label
UNION ALL SELECT 'category', attack_cat, count(*), round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) FROM named GROUP BY attack_cat
UNION ALL SELECT 'nulls', 'sbytes', count(*), NULL FROM named WHERE sbytes IS NULL
""")
def verify_report(spark, sf):
    return rounded(profile.verify(named(spark, sf), "label", "attack_cat"))


@query("topk_preview", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5
""")
def topk_preview(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return profile.preview(o, 5, [F.desc("o_totalprice"), F.asc("o_orderkey")])


# --- packets to flows ----------------------------------------------------------------

_MEASURES = """date_diff('microsecond', min(ts), max(ts)) / 1000000::DOUBLE AS dur,
  count(*) AS packets, sum(length)::BIGINT AS bytes, count(*) FILTER (forward) AS spkts,
  coalesce(sum(length) FILTER (forward), 0)::BIGINT AS sbytes"""


@query("flow_assemble", f"""
WITH {PACKETS}, f AS (SELECT a_ip, a_port, b_ip, b_port, proto, {_MEASURES} FROM sided GROUP BY ALL)
SELECT a_ip, a_port, b_ip, b_port, proto, round(dur, 6) AS dur, spkts, packets - spkts AS dpkts, sbytes,
  bytes - sbytes AS dbytes, CASE WHEN dur > 0 THEN round(bytes / dur, 6) ELSE 0 END AS rate,
  CASE WHEN spkts > 0 THEN round(sbytes / spkts, 6) ELSE 0 END AS smean,
  CASE WHEN packets > spkts THEN round((bytes - sbytes) / (packets - spkts), 6) ELSE 0 END AS dmean FROM f
""")
def flow_assemble(spark, sf):
    return rounded(assemble_flows(packets(spark, sf)))


@query("flow_assemble_totals", f"""
WITH {PACKETS}, f AS (SELECT a_ip, a_port, b_ip, b_port, proto, {_MEASURES} FROM sided GROUP BY ALL)
SELECT proto, '-' AS service, 'Normal' AS attack_cat, count(*) AS flows, sum(packets)::BIGINT AS spkts,
  sum(packets)::BIGINT AS dpkts, sum(bytes)::BIGINT AS sbytes, round(sum(bytes / packets), 4) AS dmean FROM f GROUP BY proto
""")
def flow_assemble_totals(spark, sf):
    nb = to_nb15(assemble_flows(packets(spark, sf), split_directions=False))
    return nb.groupBy("proto", "service", "attack_cat").agg(
        F.count("*").alias("flows"), F.sum("spkts").alias("spkts"), F.sum("dpkts").alias("dpkts"),
        F.sum("sbytes").alias("sbytes"), F.round(F.sum("dmean"), 4).alias("dmean"))


# --- sampling ----------------------------------------------------------------------------

@query("sample_per_class", f"""
WITH {FLOWS}, r AS (
  SELECT row_id, protocol_type, row_number() OVER (PARTITION BY protocol_type ORDER BY {hash_sql()}, row_id) AS r FROM flows)
SELECT row_id, protocol_type FROM r
WHERE r <= CASE protocol_type WHEN 'error' THEN 700 WHEN 'click' THEN 350 WHEN 'view' THEN 1000000 ELSE 0 END
""")
def sample_per_class(spark, sf):
    f = flows(spark, sf).select("row_id", F.col("protocol_type"))
    named_ = f.withColumn("kind", F.initcap("protocol_type"))
    quotas = {"error": 700, "click": 350, "view": 1_000_000}
    return sample_quota(named_, "kind", quotas, "row_id", ignore_case=True).drop("kind")


@query("sample_fraction", f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE {unit_sql("l_orderkey || '|' || l_linenumber || '|' || l_partkey")} < 0.1
""")
def tenth(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return sample_fraction(table(spark, sf, "lineitem").select(*keys), 0.1, keys)


@query("split_random", f"""
WITH {FLOWS}, u AS (SELECT row_id, {unit_sql()} AS u FROM flows)
SELECT row_id, CASE WHEN u < 0.72 THEN 'train' WHEN u < 0.9 THEN 'test' ELSE 'validation' END AS split FROM u
""")
def random_parts(spark, sf):
    return split_random(flows(spark, sf).select("row_id"), [0.72, 0.18, 0.1], "row_id")


@query("split_stratified", f"""
WITH {FLOWS}, r AS (
  SELECT row_id, labels, row_number() OVER (PARTITION BY labels ORDER BY {hash_sql()}, row_id) AS r,
    count(*) OVER (PARTITION BY labels) AS n FROM flows)
SELECT row_id, labels, CASE WHEN r <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split FROM r
""")
def stratified(spark, sf):
    return split_stratified(flows(spark, sf).select("row_id", "labels"), "labels", 0.2, "row_id")


@query("kfold_assign", f"WITH {FLOWS} SELECT row_id, CAST({hash_sql()} % 3 AS INTEGER) AS fold FROM flows")
def kfold(spark, sf):
    return with_fold(flows(spark, sf).select("row_id"), 3, "row_id")


# --- power laws ------------------------------------------------------------------------

_ZETA = ("(list_sum(list_transform(range(0, 12), lambda k: power({q} + k, -({s})))) + power({q} + 12, 1 - {s}) / ({s} - 1)"
         " + power({q} + 12, -({s})) / 2 + {s} * power({q} + 12, -({s}) - 1) / 12"
         " - {s} * ({s} + 1) * ({s} + 2) * power({q} + 12, -({s}) - 3) / 720)")


@query("powerlaw_alpha", f"""
WITH c AS (SELECT ceil(value) AS x, count(*) AS n FROM events WHERE ceil(value) > 0 GROUP BY 1),
t AS (SELECT x, sum(n) OVER w AS tail, sum(n * ln(x)) OVER w AS logs, max(x) OVER () AS top FROM c
  WINDOW w AS (ORDER BY x DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT x AS xmin, tail AS tn, 1 + tail / (logs - tail * ln(x - 0.5)) AS alpha FROM t WHERE x < top),
z AS (SELECT xmin, tn, alpha, {_ZETA.format(s="alpha", q="xmin")} AS z FROM a),
d AS (SELECT xmin, any_value(tn) AS tn, any_value(alpha) AS alpha,
    max(abs(t.tail / z.tn - {_ZETA.format(s="z.alpha", q="t.x")} / z.z)) AS distance
  FROM z JOIN t ON t.x >= z.xmin GROUP BY xmin)
SELECT 'bytes' AS feature, (SELECT sum(n) FROM c)::BIGINT AS rows, tn::BIGINT AS tail_rows, xmin,
  round(alpha, 6) AS alpha, round(distance, 6) AS distance FROM d ORDER BY distance, xmin LIMIT 1
""")
def powerlaw_alpha(spark, sf):
    df = table(spark, sf, "events").select(F.ceil("value").cast("double").alias("bytes"))
    fit = fit_power_law(df, "bytes")
    return rounded(small_table(
        spark,
        [(fit.column, fit.rows, fit.tail_rows, fit.xmin, fit.alpha, fit.distance)],
        "feature string, rows bigint, tail_rows bigint, xmin double, alpha double, distance double"))


@query("powerlaw_compare")
def powerlaw_compare(spark, sf):
    df = table(spark, sf, "events").select(F.ceil("value").cast("double").alias("bytes"))
    fit = fit_power_law(df, "bytes")
    rows = [(r["alternative"], r["ratio"], r["p"], r["rows"]) for r in
            (compare_tails(df, fit, name) for name in ("exponential", "lognormal"))]
    return small_table(spark, rows, "alternative string, ratio double, p double, rows bigint")
