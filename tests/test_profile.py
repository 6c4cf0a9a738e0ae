from netweave.operators import profile as pr
from netweave.plans import vocab


def test_text_profile_is_cut_after_fifty_characters(spark):
    df = spark.range(200).selectExpr("'c' AS y", "CAST(id % 90 AS string) AS s", "id % 2 AS b")
    whole = pr.profile_by_class(df, "y", {"g": ("s",)}).first()["note"]
    assert whole == "values: " + ", ".join(sorted(str(i) for i in range(90)))
    note = pr.profile_by_class(df, "y", {"g": ("s",)}, max_chars=50).first()["note"]
    assert note.startswith("values: 0, 1, 10, 11") and note.endswith("...") and len(note) == len("values: ") + 53
    count = pr.profile_by_class(df, "y", {"g": ("s",)}, text_as="count").first()
    assert count["note"] == "distinct: 90" and count["category"] == "g" and count["rows"] == 200


def test_numeric_feature_named_as_text(spark):
    df = spark.range(3).selectExpr("'c' AS y", "id")
    assert pr.profile_by_class(df, "y", {"g": ("id", "absent")}, text=("id",)).first()["note"] == "values: 0, 1, 2"


def test_missing_counts_as_used(spark):
    df = spark.createDataFrame([("c", None), ("c", 0.0)], "y string, v double")
    row = pr.profile_by_class(df, "y", {"g": ("v",)}).first()
    assert row["usage"] == 50.0 and row["note"] == "used"


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1.0, 2.0, 10.0, None]], "x double")
    rows = {r["bin"]: r["n"] for r in pr.histogram(df, "x", 5).collect()}
    assert rows == {0: 2, 1: 1, 2: 0, 3: 0, 4: 1}
    wild = spark.createDataFrame([("a", v) for v in [0.0, 4.0, float("inf"), float("nan")]] + [("b", 1.0), ("b", None)], "g string, x double")
    both = {(r["g"], r["bin"]): (r["n"], r["density"]) for r in pr.histogram(wild, "x", 2, ["g"]).collect()}
    assert both == {("a", 0): (1, 0.25), ("a", 1): (1, 0.25), ("b", 0): (1, 0.5), ("b", 1): (0, 0.0)}
    constant = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r["bin"], r["n"]) for r in pr.histogram(constant, "x", 5).collect()] == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 0)]
    assert pr.histogram(constant.where("x > 5"), "x").count() == 0


def test_families():
    pairs = vocab.family_pairs(vocab.KDD_FAMILIES)
    assert pairs["neptune"] == "dos" and pairs["xsnoop"] == "r2l" and len(pairs) == 37
    assert vocab.family_pairs(vocab.NB15_FAMILIES)["Worms"] == "worm"


def test_describe_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    rows = {r["feature"]: r for r in pr.describe(df).collect()}
    assert rows["a"]["count"] == 0 and rows["a"]["median"] is None and rows["b"]["median"] == 1.0
