import pytest
from pyspark.sql import functions as F

from netweave.functions import binary_label, coerce_double, detect_label_rule, map_contains
from netweave.operators.tables import coerce_if_all, convert, fill_mean, missing_columns, union_all, union_tagged
from netweave.plans import SPECS, conform, vocab
from netweave.plans.mapping import align, first_present, rename_present, strip_names, unmapped_labels
from netweave.plans.schemas import CIC_COLUMNS, KDD_COLUMNS, NB15_COLUMNS, UNSW_RAW_COLUMNS

LAYOUTS = {
    "nb15_to_kdd": KDD_COLUMNS, "cic_to_kdd": KDD_COLUMNS, "cic_to_kdd_binary": KDD_COLUMNS,
    "mqtt_to_kdd": KDD_COLUMNS, "ukm_to_kdd": KDD_COLUMNS, "bot_to_kdd": KDD_COLUMNS,
    "cic_to_nb15": NB15_COLUMNS, "cic_to_nb15_derived": NB15_COLUMNS, "cic_to_nb15_direct": NB15_COLUMNS,
    "ctu_to_unsw": UNSW_RAW_COLUMNS, "kdd_to_cic": CIC_COLUMNS,
}


def test_layout_sizes():
    assert (len(KDD_COLUMNS), len(NB15_COLUMNS), len(UNSW_RAW_COLUMNS), len(CIC_COLUMNS)) == (42, 45, 49, 77)


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layout_of_an_almost_empty_source(spark, name):
    """Whatever the source lacks, the target layout is complete and in order."""
    source = spark.createDataFrame([(1, "x")], "unrelated int, other string")
    out = conform(source, SPECS[name])
    assert out.columns == list(LAYOUTS[name])
    assert out.count() == 1


@pytest.mark.parametrize("name", sorted(SPECS))
def test_conversion_has_no_shuffle(spark, name):
    source = spark.range(5).select(F.col("id").cast("string").alias("Label"), F.lit(1.0).alias("dur"))
    plan = conform(source, SPECS[name])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_contained_labels(spark):
    cases = {
        "Web Attack – Brute Force": (1, "BruteForce"), "DDoS": (1, "DoS"), " BENIGN ": (0, "Normal"), None: (1, "Other"),
        "Web Attack – XSS": (1, "Web"), "Infiltration": (1, "Exploits"), "Bot": (1, "Backdoor"), "new": (1, "Other"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    found = df.select("t", map_contains(F.col("t"), vocab.CIC_LABEL_PARTS, ("BENIGN", "Normal"), "Other").alias("x"))
    assert {r["t"]: (r["x"]["label"], r["x"]["category"]) for r in found.collect()} == cases


def test_last_present_source_wins(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "`Flow IAT Mean` double, `Fwd IAT Mean` double, `Fwd Header Length` double")
    row = conform(df, SPECS["cic_to_nb15"]).first()
    assert (row["sinpkt"], row["swin"]) == (2.0, 3.0)


def test_derived_option_fills_ttl_and_load(spark):
    df = spark.createDataFrame([(2.0, 10.0, 4.0)], "`Flow Duration` double, `Total Length of Fwd Packets` double, `Total Length of Bwd Packets` double")
    plain, derived = (conform(df, SPECS[n]).first() for n in ("cic_to_nb15", "cic_to_nb15_derived"))
    assert (plain["sttl"], plain["sload"]) == (0.0, 0.0)
    assert derived["sttl"] == 64.0
    assert derived["sload"] == pytest.approx(5.0, rel=1e-5)


def test_one_source_feeds_many_targets_and_absent_ones_get_the_sentinel(spark):
    df = spark.createDataFrame([(7.0, 1)], "`Flow Duration` double, Label int")
    row = conform(df, SPECS["ctu_to_nb15"]).first()
    assert (row["dur"], row["ct_srv_src"], row["spkts"], row["attack_cat"], row["label"]) == (7.0, 7.0, -1.0, "Bot", 1.0)


def test_infinity_is_kept_and_null_filled(spark):
    df = spark.createDataFrame([(float("inf"), None)], "`Flow Bytes/s` double, `Flow IAT Mean` double")
    row = conform(df, SPECS["cic_to_kdd"]).first()
    assert row["srv_count"] == float("inf") and row["serror_rate"] == 0.0


def test_strict_labels(spark):
    df = spark.createDataFrame([("DDoS",), ("DoS Hulk",), ("DoS Hulk",)], "Label string")
    assert [(r["label"], r["rows"]) for r in unmapped_labels(df, SPECS["cic_to_kdd"]).collect()] == [("DoS Hulk", 2)]
    with pytest.raises(ValueError, match="DoS Hulk"):
        conform(df, SPECS["cic_to_kdd"], unmapped="strict")
    assert conform(df, SPECS["cic_to_kdd"]).where("labels = 'normal'").count() == 2


def test_sequence_ids(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.lit("BENIGN").alias("Label"))
    out = convert(df, SPECS["cic_to_nb15"], order_by=["k"])
    assert sorted(r["id"] for r in out.collect()) == list(range(10))
    assert out.columns[0] == "id" and set(out.columns) == set(NB15_COLUMNS)


def test_rename_align_and_names(spark):
    df = spark.createDataFrame([(1, 2)], "` a ` int, b int")
    clean = strip_names(df)
    assert clean.columns == ["a", "b"]
    assert rename_present(clean, {"a": "x", "zz": "y"}).columns == ["x", "b"]
    assert rename_present(clean, {"a": "x", "zz": "y"}, only=True).columns == ["x"]
    assert align(clean, ["c", "a"]).first().asDict() == {"c": 0, "a": 1}
    assert first_present(clean.columns, ["q", "b", "a"]) == "b"
    assert missing_columns(clean, ["a", "q"]) == ["q"]


def test_text_numbers(spark):
    cases = {"1d": None, "2.5F": None, " 12 ": 12.0, "inf": float("inf"), "NaN": None, "": None, "1e3": 1000.0, None: None, "x": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", coerce_double(F.col("t")).alias("v")).collect()} == cases


def test_coerce_whole_columns_only(spark):
    df = spark.createDataFrame([("1", "1"), (None, "x")], "a string, b string")
    assert dict(coerce_if_all(df).dtypes) == {"a": "double", "b": "string"}


@pytest.mark.parametrize("values,rule", [
    ([0, 1], "numeric"), (["0", "1"], "numeric"), (["Normal", "x"], "normal"), (["benign", "x"], "benign"),
    (["attack", "x"], "attack"), (["b", "a"], "first:b"),
])
def test_label_rules(spark, values, rule):
    kind = "int" if isinstance(values[0], int) else "string"
    df = spark.createDataFrame(list(enumerate(values)), f"k int, y {kind}")
    assert detect_label_rule(df, "y", "k") == rule
    got = [r["v"] for r in df.orderBy("k").select(binary_label(F.col("y"), rule).alias("v")).collect()]
    assert got == ([1, 0] if rule == "attack" else [0, 1])


def test_unions(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3, 4)], "z int, x int")
    out = union_all([a, b], allow_missing=True)
    assert {tuple(r) for r in out.select("x", "y", "z").collect()} == {(1, 2, None), (4, None, 3)}
    tagged = union_tagged({"one": a, "two": b})
    assert tagged.columns[-1] == "source" and tagged.count() == 2
    with pytest.raises(ValueError):
        union_all([])


def test_mean_ignores_nan(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    assert sorted(r["x"] for r in fill_mean(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]
