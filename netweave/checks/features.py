"""Encoding, clipping, scaling, selection and the fitted chain."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from netweave.checks.base import FLOWS, LABELLED, NUMERIC, TEXT, flows, labelled, query, rounded, table
from netweave.functions import numeric
from netweave.operators import features as feat
from netweave.plans.presets import standard_limited
from netweave.session import small_table

# --- encoding ------------------------------------------------------------------------


@query("encode_fit", """
SELECT 'o_orderpriority' AS feature, value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT o_orderpriority AS value FROM orders UNION SELECT '')
UNION ALL
SELECT 'o_orderstatus', value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER)
FROM (SELECT DISTINCT o_orderstatus AS value FROM orders UNION SELECT '')
""")
def encode_fit(spark, sf):
    return feat.fit_encoder(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"]).vocab


def shifted(spark, sf):
    """Flows whose text holds values that a fit on the signup-free rows never saw."""
    f = flows(spark, sf)
    return f.where("protocol_type <> 'signup'"), f.select(
        "row_id", F.when(F.col("flag") == "S0", F.lit(None)).otherwise(F.col("protocol_type")).alias("protocol_type"), "flag")


@query("encode_apply", f"""
WITH {FLOWS}, v AS (
  SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code FROM (
    SELECT DISTINCT protocol_type AS value FROM flows WHERE protocol_type <> 'signup' UNION SELECT ''))
SELECT row_id, flag, CAST(coalesce(v.code, 0) AS INTEGER) AS protocol_type, 0 AS missing
FROM (SELECT row_id, flag, CASE WHEN flag = 'S0' THEN '' ELSE protocol_type END AS p FROM flows) f LEFT JOIN v ON v.value = f.p
""")
def encode_apply(spark, sf):
    seen, other = shifted(spark, sf)
    encoder = feat.fit_encoder(seen.withColumn("missing", F.lit("x")), ["protocol_type", "missing"])
    return encoder.apply(other)


@query("unseen_values", f"""
WITH {FLOWS}
SELECT 'protocol_type' AS feature, protocol_type AS value, count(*) AS rows FROM flows
WHERE flag <> 'S0' AND protocol_type = 'signup' GROUP BY 2
""")
def unseen_values(spark, sf):
    seen, other = shifted(spark, sf)
    return feat.fit_encoder(seen, ["protocol_type"]).unseen_values(other)


@query("encode_all", """
SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(dense_rank() OVER (ORDER BY l_returnflag) AS INTEGER) - CAST(min('nan') OVER () > l_returnflag AS INTEGER) AS l_returnflag,
  CAST(dense_rank() OVER (ORDER BY l_linestatus) AS INTEGER) - CAST(min('nan') OVER () > l_linestatus AS INTEGER) AS l_linestatus
FROM lineitem
""")
def encode_all(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    return feat.encode_text(li)[0]


@query("one_hot", f"""
WITH {FLOWS}
SELECT row_id, src_bytes, CAST(flag = 'REJ' AS INTEGER) AS "flag_REJ", CAST(flag = 'S0' AS INTEGER) AS "flag_S0",
  CAST(flag = 'SF' AS INTEGER) AS "flag_SF" FROM flows
""")
def one_hot(spark, sf):
    return feat.one_hot(flows(spark, sf).select("row_id", "src_bytes", "flag"))


@query("one_hot_scaled", f"""
WITH {FLOWS}, o AS (SELECT row_id, src_bytes, CAST(flag = 'REJ' AS INTEGER) AS "flag_REJ",
    CAST(flag = 'S0' AS INTEGER) AS "flag_S0", CAST(flag = 'SF' AS INTEGER) AS "flag_SF" FROM flows),
s AS (SELECT {", ".join(f'avg("{c}") AS a_{c}, stddev_pop("{c}") AS s_{c}' for c in ("src_bytes", "flag_REJ", "flag_S0", "flag_SF"))} FROM o)
SELECT row_id, {", ".join(f'round(("{c}" - a_{c}) / s_{c}, 6) AS "{c}"' for c in ("src_bytes", "flag_REJ", "flag_S0", "flag_SF"))} FROM o, s
""")
def one_hot_scaled(spark, sf):
    """One column per value, then standard scaling of all of them."""
    wide = feat.one_hot(flows(spark, sf).select("row_id", "src_bytes", "flag"))
    return rounded(feat.fit_scaler(wide, wide.columns[1:], "standard").apply(wide))


# --- clipping ------------------------------------------------------------------------

def _bounds_sql(c):
    return f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3"


BOUNDS = FLOWS + ", q AS (SELECT " + ", ".join(_bounds_sql(c) for c in NUMERIC) + " FROM flows)"


def _iqr_sql(c):
    return f"least(greatest({c}, {c}_q1 - 1.5 * ({c}_q3 - {c}_q1)), {c}_q3 + 1.5 * ({c}_q3 - {c}_q1))"


CLIPPED = BOUNDS + ", clipped AS (SELECT row_id, labels, protocol_type, flag, " + ", ".join(
    f"{_iqr_sql(c)} AS {c}" for c in NUMERIC) + " FROM flows, q)"


def numbers(spark, sf, *more):
    return flows(spark, sf).select("row_id", *more, *NUMERIC)


def clipped(spark, sf, *more):
    df = numbers(spark, sf, *more)
    return feat.fit_bounds(df, NUMERIC).apply(df)


@query("iqr_bounds", f"WITH {BOUNDS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round({c}_q1 - 1.5 * ({c}_q3 - {c}_q1), 6) AS low, "
    f"round({c}_q3 + 1.5 * ({c}_q3 - {c}_q1), 6) AS high FROM q" for c in NUMERIC))
def iqr_bounds(spark, sf):
    limits = feat.fit_bounds(numbers(spark, sf), NUMERIC).limits
    return rounded(small_table(spark, [(c, *v) for c, v in limits.items()], "feature string, low double, high double"))


def _rounded_sql(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


@query("clip_iqr", f"WITH {CLIPPED} SELECT row_id, {_rounded_sql(NUMERIC)} FROM clipped")
def clip_iqr(spark, sf):
    return rounded(clipped(spark, sf))


@query("clip_zscore", """
WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d, avg(l_quantity) AS mq,
  stddev_samp(l_quantity) AS dq FROM lineitem)
SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, m - 3 * d), m + 3 * d), 4) AS l_extendedprice,
  round(least(greatest(l_quantity, mq - 3 * dq), mq + 3 * dq), 4) AS l_quantity FROM lineitem, s
""")
def clip_zscore(spark, sf):
    cols = ["l_extendedprice", "l_quantity"]
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in cols])
    return rounded(feat.fit_bounds(li, cols, "zscore").apply(li), 4)


@query("clip_percentile", f"""
WITH {FLOWS}, q AS (SELECT {", ".join(f"quantile_cont({c}, [0.01, 0.99]) AS {c}_q" for c in NUMERIC)} FROM flows)
SELECT row_id, {", ".join(f"round(least(greatest({c}, {c}_q[1]), {c}_q[2]), 6) AS {c}" for c in NUMERIC)} FROM flows, q
""")
def clip_percentile(spark, sf):
    df = numbers(spark, sf)
    return rounded(feat.fit_bounds(df, NUMERIC, "percentile").apply(df))


# --- skew and scaling ------------------------------------------------------------------

@query("skew_adjusted", f"WITH {CLIPPED} SELECT {', '.join(f'round(skewness({c}), 6) AS {c}' for c in NUMERIC)} FROM clipped")
def skew_adjusted(spark, sf):
    df = clipped(spark, sf)
    return rounded(df.agg(*[feat.adjusted_skewness(F.col(c)).alias(c) for c in NUMERIC]))


LOGGED = CLIPPED + """, k AS (SELECT """ + ", ".join(
    f"skewness({c}) > 1 AS {c}_k, min({c}) AS {c}_m" for c in NUMERIC) + """ FROM clipped),
logged AS (SELECT row_id, labels, protocol_type, flag, """ + ", ".join(
    f"CASE WHEN {c}_k THEN ln(1 + ({c} - {c}_m + 0.000001)) ELSE {c} END AS {c}" for c in NUMERIC) + " FROM clipped, k)"


@query("skew_log", f"WITH {LOGGED} SELECT row_id, {_rounded_sql(NUMERIC)} FROM logged")
def skew_log(spark, sf):
    df = clipped(spark, sf)
    return rounded(feat.fit_skew_log(df, NUMERIC).apply(df))


ROBUST = LOGGED + """, rq AS (SELECT """ + ", ".join(
    f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS {c}_r" for c in NUMERIC) + """ FROM logged),
robust AS (SELECT row_id, labels, protocol_type, flag, """ + ", ".join(
    f"({c} - {c}_r[2]) / CASE WHEN {c}_r[3] = {c}_r[1] THEN 1 ELSE {c}_r[3] - {c}_r[1] END AS {c}" for c in NUMERIC
) + " FROM logged, rq)"


@query("scale_robust", f"WITH {ROBUST} SELECT row_id, {_rounded_sql(NUMERIC)} FROM robust")
def scale_robust(spark, sf):
    df = clipped(spark, sf)
    logged = feat.fit_skew_log(df, NUMERIC).apply(df)
    return rounded(feat.fit_scaler(logged, NUMERIC, "robust").apply(logged))


@query("scale_standard", f"""
WITH {FLOWS}, f AS (SELECT *, 3.0::DOUBLE AS constant FROM flows),
s AS (SELECT {", ".join(f"avg({c}) AS {c}_a, stddev_pop({c}) AS {c}_s" for c in NUMERIC)} FROM f)
SELECT row_id, 0.0::DOUBLE AS constant, {", ".join(f"round(({c} - {c}_a) / {c}_s, 6) AS {c}" for c in NUMERIC)} FROM f, s
""")
def scale_standard(spark, sf):
    df = numbers(spark, sf).withColumn("constant", F.lit(3.0))
    return rounded(feat.fit_scaler(df, [*NUMERIC, "constant"], "standard").apply(df))


@query("scale_minmax", f"""
WITH {FLOWS}, s AS (SELECT {", ".join(f"min({c}) AS {c}_a, max({c}) AS {c}_b" for c in NUMERIC)} FROM flows)
SELECT row_id, {", ".join(f"round(({c} - {c}_a) / ({c}_b - {c}_a), 6) AS {c}" for c in NUMERIC)} FROM flows, s
""")
def scale_minmax(spark, sf):
    df = numbers(spark, sf)
    return rounded(feat.fit_scaler(df, NUMERIC, "minmax").apply(df))


@query("scale_global_minmax", f"""
WITH {FLOWS}, s AS (SELECT least({", ".join(f"min({c})" for c in NUMERIC)}) AS a,
  greatest({", ".join(f"max({c})" for c in NUMERIC)}) AS b FROM flows)
SELECT row_id, {", ".join(f"round(({c} - a) / (b - a), 6) AS {c}" for c in NUMERIC)} FROM flows, s
""")
def scale_global_minmax(spark, sf):
    df = numbers(spark, sf)
    return rounded(feat.fit_scaler(df, NUMERIC, "global_minmax").apply(df))


def _position_sql(c):
    """Rank position: middle of equal knots, else straight between the two around."""
    return f"""CASE WHEN {c} <= k_{c}[1] THEN 0 WHEN {c} >= k_{c}[1000] THEN 1
    WHEN up_{c} > below_{c} THEN (below_{c} + up_{c} - 1) / 2.0::DOUBLE / 999
    ELSE (up_{c} - 1 + ({c} - k_{c}[up_{c}]) / (k_{c}[up_{c} + 1] - k_{c}[up_{c}])) / 999.0::DOUBLE END"""


_POSITIONED = ("src_bytes", "duration")
POSITIONS = FLOWS + ", k AS (SELECT " + ", ".join(
    f"quantile_cont({c}, list_transform(range(0, 1000), lambda i: i / 999::DOUBLE)) AS k_{c}" for c in _POSITIONED
) + " FROM flows), counted AS (SELECT row_id, " + ", ".join(
    f"{c}, k_{c}, len(list_filter(k_{c}, lambda x: x <= {c})) AS up_{c}, len(list_filter(k_{c}, lambda x: x < {c})) AS below_{c}"
    for c in _POSITIONED) + " FROM flows, k)"


@query("scale_quantile", f"WITH {POSITIONS} SELECT row_id, " + ", ".join(
    f"round({_position_sql(c)}, 6) AS {c}" for c in _POSITIONED) + " FROM counted")
def scale_quantile(spark, sf):
    df = flows(spark, sf).select("row_id", *_POSITIONED)
    return rounded(feat.fit_quantile_scaler(df, _POSITIONED, normal=False).apply(df))


def _polynomial(x, weights):
    out = f"{weights[-1]!r}::DOUBLE"
    for w in weights[-2::-1]:
        out = f"({out} * {x} + {w!r}::DOUBLE)"
    return out


def _normal_sql(c):
    """The normal quantile of the position ``u_<c>``, from the published approximations."""
    central, middle, tail = ([_polynomial(x, w) for w in pair] for x, pair in (
        (f"(0.180625::DOUBLE - q_{c} * q_{c})", numeric.CENTRAL), (f"(t_{c} - 1.6::DOUBLE)", numeric.MIDDLE),
        (f"(t_{c} - 5::DOUBLE)", numeric.TAIL)))
    outer = f"CASE WHEN t_{c} <= 5 THEN {middle[0]} / {middle[1]} ELSE {tail[0]} / {tail[1]} END"
    return f"CASE WHEN abs(q_{c}) <= 0.425 THEN q_{c} * {central[0]} / {central[1]} ELSE sign(q_{c}) * {outer} END"


NORMAL = POSITIONS + ", u AS (SELECT row_id, " + ", ".join(
    f"least(greatest({_position_sql(c)}, 1e-7::DOUBLE), {1 - 1e-7!r}::DOUBLE) AS u_{c}" for c in _POSITIONED
) + " FROM counted), q AS (SELECT row_id, " + ", ".join(
    f"u_{c} - 0.5::DOUBLE AS q_{c}, sqrt(-ln(least(u_{c}, 1 - u_{c}))) AS t_{c}" for c in _POSITIONED
) + " FROM u), z AS (SELECT row_id, " + ", ".join(f"{_normal_sql(c)} AS {c}" for c in _POSITIONED) + """ FROM q),
rq AS (SELECT """ + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS r_{c}" for c in _POSITIONED) + """ FROM z),
r AS (SELECT row_id, """ + ", ".join(f"({c} - r_{c}[2]) / (r_{c}[3] - r_{c}[1]) AS {c}" for c in _POSITIONED) + """ FROM z, rq),
s AS (SELECT """ + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in _POSITIONED) + " FROM r)"


@query("scale_quantile_normal", f"WITH {NORMAL} SELECT row_id, " + ", ".join(
    f"round(({c} - a_{c}) / s_{c}, 6) AS {c}" for c in _POSITIONED) + " FROM r, s")
def scale_quantile_normal(spark, sf):
    """Positions mapped on to a normal distribution, then robust and standard scaling."""
    df = flows(spark, sf).select("row_id", *_POSITIONED)
    for fit in (feat.fit_quantile_scaler, lambda d, c: feat.fit_scaler(d, c, "robust"),
                lambda d, c: feat.fit_scaler(d, c, "standard")):
        df = fit(df, _POSITIONED).apply(df)
    return rounded(df)


# --- selection --------------------------------------------------------------------------

def _corr_sql(c, source):
    return f"CASE WHEN max({c}) > min({c}) THEN corr({c}, CAST(labels <> 'normal' AS DOUBLE)) END FROM {source}"


@query("feature_label_corr", f"WITH {ROBUST}, r AS (SELECT *, 1.0::DOUBLE AS constant FROM robust) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(r, 6) AS correlation FROM (SELECT {_corr_sql(c, 'r').replace(' FROM', ' AS r FROM')})"
    for c in [*NUMERIC, "constant"]))
def feature_label_corr(spark, sf):
    return rounded(feat.label_correlation(scaled(spark, sf), [*NUMERIC, "constant"], "label"))


def scaled(spark, sf):
    df = clipped(spark, sf, "labels").withColumn("label", (F.col("labels") != "normal").cast("int"))
    logged = feat.fit_skew_log(df, NUMERIC).apply(df)
    return feat.fit_scaler(logged, NUMERIC, "robust").apply(logged).withColumn("constant", F.lit(1.0))


def _select_sql(extra):
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i} AS o, abs(r) AS r FROM (SELECT {_corr_sql(c, 'robust').replace(' FROM', ' AS r FROM')})"
        for i, c in enumerate(NUMERIC))
    return f"WITH {ROBUST}, r AS ({parts}) SELECT feature FROM r {extra}"


@query("select_by_corr", _select_sql("WHERE r > 0.01"))
def select_by_corr(spark, sf):
    chosen = feat.select_by_corr(scaled(spark, sf), [*NUMERIC, "constant"], "label")
    return small_table(spark, [(c,) for c in chosen], "feature string")


@query("topk_features", _select_sql("ORDER BY r DESC, feature LIMIT 3"))
def topk_features(spark, sf):
    chosen = feat.select_by_corr(scaled(spark, sf), [*NUMERIC, "constant"], "label", top=3)
    return small_table(spark, [(c,) for c in chosen], "feature string")


# --- the chain --------------------------------------------------------------------------

_ORDER = {c: i for i, c in enumerate(NUMERIC)}
_PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]
CHAIN = ROBUST + ", kept AS (SELECT " + ", ".join(
    f"CASE WHEN max({c}) > min({c}) THEN abs(corr({c}, CAST(labels <> 'normal' AS DOUBLE))) > 0.01 ELSE false END AS {c}_s"
    for c in NUMERIC) + """ FROM robust),
pv AS (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT protocol_type AS value FROM flows UNION SELECT '')),
fv AS (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT flag AS value FROM flows UNION SELECT '')),
tall AS (
""" + " UNION ALL ".join(
    [f"SELECT row_id, '{c}' AS feature, {c} AS v FROM robust, kept WHERE {c}_s" for c in NUMERIC]
    + [f"SELECT row_id, '{a}_{b}_inter', {a} * {b} FROM robust, kept WHERE {a}_s AND {b}_s" for a, b in _PAIRS]
    + ["SELECT row_id, 'protocol_type', code::DOUBLE FROM robust JOIN pv ON pv.value = protocol_type",
       "SELECT row_id, 'flag', code::DOUBLE FROM robust JOIN fv ON fv.value = flag"]) + """),
norm AS (SELECT feature, avg(v) AS a, stddev_pop(v) AS s FROM tall GROUP BY feature)
"""


@query("preprocess_fit_apply", f"WITH {CHAIN} SELECT row_id, feature, round((v - a) / s, 5) AS value FROM tall JOIN norm USING (feature)")
def preprocess_fit_apply(spark, sf):
    df = labelled(spark, sf)
    model = feat.FlowPreprocessor(numeric=NUMERIC, text=TEXT, label="label").fit(df)
    out = model.transform(df, keep=["row_id"])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(c), 5).alias("value")) for c in model.feature_names()])
    return out.select("row_id", F.explode(cells).alias("x")).select("row_id", "x.*")


@query("preprocess_subset", f"""
WITH {FLOWS}, l AS (SELECT row_id, ln(1 + src_bytes) AS src_bytes, ln(1 + dst_bytes) AS dst_bytes, ln(1 + duration) AS duration FROM flows),
s AS (SELECT {", ".join(f"min({c}) AS {c}_a, max({c}) AS {c}_b" for c in ("src_bytes", "dst_bytes", "duration"))} FROM l)
SELECT row_id, {", ".join(f"round(({c} - {c}_a) / ({c}_b - {c}_a), 6) AS {c}" for c in ("src_bytes", "dst_bytes", "duration"))} FROM l, s
""")
def preprocess_subset(spark, sf):
    """Logarithms and min-max scaling, the smallest preset chain."""
    cols = ["src_bytes", "dst_bytes", "duration"]
    chain = feat.FlowPreprocessor(numeric=cols, log_cols=cols, clip=None, skew_threshold=None, scale="minmax",
                                  select_threshold=None, use_pairs=False, standardize=False)
    df = flows(spark, sf)
    return rounded(chain.fit(df).transform(df, keep=["row_id"]))


_GAPPED = ("duration", "src_bytes", "dst_bytes")
_ENDS = [*_GAPPED, "flag"]


@query("preprocess_limited", f"""
WITH {FLOWS}, g AS (SELECT row_id, duration, CASE WHEN flag <> 'S0' THEN src_bytes END AS src_bytes, dst_bytes,
    (dense_rank() OVER (ORDER BY flag))::DOUBLE AS flag FROM flows),
m AS (SELECT avg(src_bytes) AS mean FROM g),
f AS (SELECT row_id, duration, coalesce(src_bytes, mean) AS src_bytes, dst_bytes, flag FROM g, m),
s AS (SELECT {", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in _GAPPED)} FROM f),
l AS (SELECT row_id, {", ".join(f"least(greatest(({c} - a_{c}) / s_{c}, -1.25::DOUBLE), 1.25::DOUBLE) AS {c}" for c in _GAPPED)},
    least(flag, 1.25::DOUBLE) AS flag FROM f, s),
e AS (SELECT least({", ".join(f"min({c})" for c in _ENDS)}) AS low, greatest({", ".join(f"max({c})" for c in _ENDS)}) AS high FROM l)
SELECT row_id, {", ".join(f"round(({c} - low) / (high - low), 6) AS {c}" for c in _ENDS)} FROM l, e
""")
def preprocess_limited(spark, sf):
    """Means for gaps, standard scaling, a limit that binds, one range over numbers and codes together."""
    df = flows(spark, sf).withColumn("src_bytes", F.when(F.col("flag") != "S0", F.col("src_bytes")))
    chain = replace(standard_limited(_GAPPED, ["flag"]), limit=1.25)
    return rounded(chain.fit(df).transform(df, keep=["row_id"]))
