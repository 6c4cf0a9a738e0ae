import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.operators import augment as aug
from netweave.operators.neighbors import nearest
from netweave.operators.profile import balance_report
from netweave.operators.resample import _repeat, nearest_domain, smote


def brute(q, r, qid, rid, k, own, qc=None, rc=None, penalty=0.0):
    out = {}
    for i, x in zip(qid, q):
        d = ((r - x) ** 2).sum(axis=1)
        if qc is not None:
            d = d + penalty * np.array([sum(a != b for a, b in zip(qc[i], c)) for c in rc])
        pairs = sorted((d[j], rid[j]) for j in range(len(rid)) if not (own and rid[j] == i))
        out[i] = [p[1] for p in pairs[:k]]
    return out


def table(spark, points, first=0, codes=None):
    rows = [(first + i, *map(float, p), *(codes[i] if codes else ())) for i, p in enumerate(points)]
    kinds = ", ".join(f"x{j} double" for j in range(points.shape[1]))
    return spark.createDataFrame(rows, f"k bigint, {kinds}" + (", c string" if codes else ""))


def lists(df):
    out = {}
    for r in df.orderBy("k", "rank").collect():
        out.setdefault(r["k"], []).append(r["neighbor"])
    return out


@pytest.mark.parametrize("block", [40, 10_000])
@pytest.mark.parametrize("kind", ["cloud", "hot", "grid"])
def test_neighbours_equal_brute_force(spark, monkeypatch, block, kind):
    monkeypatch.setattr("netweave.operators.neighbors._NEAR_BLOCKS", 2)
    rng = np.random.default_rng(5)
    if kind == "cloud":
        p = rng.normal(size=(500, 4))
    elif kind == "hot":  # a third of the rows are one point, another share lies in one plane
        p = rng.normal(size=(480, 3))
        p[:160] = [1.0, 2.0, 3.0]
        p[160:240, 0] = 0.0
    else:  # many equal distances
        p = rng.integers(0, 6, size=(400, 2)).astype(float)
    ids = np.arange(len(p))
    got = lists(nearest(table(spark, p), None, [f"x{j}" for j in range(p.shape[1])], "k", 5, block_rows=block))
    assert got == brute(p, p, ids, ids, 5, True)


def test_neighbours_among_another_table(spark):
    rng = np.random.default_rng(6)
    q, r = rng.normal(size=(150, 3)) * 3, rng.normal(size=(400, 3))
    got = lists(nearest(table(spark, q), table(spark, r, 1000), ["x0", "x1", "x2"], "k", 3, block_rows=30))
    assert got == brute(q, r, np.arange(150), np.arange(1000, 1400), 3, False)


def test_neighbours_with_categories(spark):
    rng = np.random.default_rng(7)
    p = rng.normal(size=(300, 2))
    codes = [("ab"[i % 2],) for i in range(300)]
    ids = np.arange(300)
    got = lists(nearest(table(spark, p, codes=codes), None, ["x0", "x1"], "k", 4, ["c"], 0.3, block_rows=40))
    assert got == brute(p, p, ids, ids, 4, True, {i: codes[i] for i in range(300)}, codes, 0.3)


@pytest.fixture(scope="module")
def lopsided(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(i < 40), "xy"[i % 2], f"d{i % 3}", *map(float, rng.normal(size=2) + 4 * (i < 40))) for i in range(200)]
    return spark.createDataFrame(rows, "k bigint, y int, c string, d string, a double, b double")


def test_synthetic_rows_lie_between_two_rows_of_their_class(lopsided):
    out = smote(lopsided, ["a", "b"], "y", "k", carry=["d"])
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 160, 1: 160}
    minority = {r["k"]: (r["a"], r["b"], r["d"]) for r in lopsided.where("y = 1").collect()}
    points = np.array([v[:2] for v in minority.values()])
    for r in out.where("draw IS NOT NULL").collect():
        seed = np.array(minority[r["k"]][:2])
        v = np.array([r["a"], r["b"]]) - seed
        to = points - seed
        cross = np.abs(to[:, 0] * v[1] - to[:, 1] * v[0])
        length = (to * to).sum(axis=1)
        share = (to @ v) / np.where(length == 0, 1, length)
        assert ((cross < 1e-9) & (share >= -1e-9) & (share <= 1 + 1e-9)).any()
        assert r["d"] == minority[r["k"]][2]
    seeds = out.where("draw IS NOT NULL").groupBy("k").count().select("count").distinct().collect()
    assert {r[0] for r in seeds} == {3}


def test_smote_is_repeatable_and_conditional(lopsided):
    one, two = (smote(d, ["a", "b"], "y", "k") for d in (lopsided, lopsided.repartition(5)))
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}
    assert smote(lopsided, ["a", "b"], "y", "k", when_below=0.1).count() == 200
    assert smote(lopsided, ["a", "b"], "y", "k", when_below=0.35).count() == 320
    assert smote(lopsided.where("y = 1"), ["a", "b"], "y", "k").count() == 40
    with pytest.raises(ValueError, match="neighbours"):
        smote(lopsided.where("y = 0 OR k < 4"), ["a", "b"], "y", "k")


def test_smote_takes_the_mode_of_categories(lopsided):
    out = smote(lopsided, ["a", "b"], "y", "k", categorical=["c"])
    values = {r["c"] for r in out.where("draw IS NOT NULL").select("c").distinct().collect()}
    assert values <= {"x", "y"} and out.count() == 320


def test_several_minority_classes(spark):
    df = spark.range(120).select(
        F.col("id").alias("k"), F.when(F.col("id") < 20, "p").when(F.col("id") < 50, "q").otherwise("r").alias("y"),
        F.col("id").cast("double").alias("a"))
    assert {r["y"]: r["count"] for r in smote(df, ["a"], "y", "k").groupBy("y").count().collect()} == {"p": 70, "q": 70, "r": 70}


def test_long_runs_are_dealt_in_steps(spark):
    rows = spark.createDataFrame([(1, 25_001), (2, 0), (3, 1)], "k bigint, _m bigint")
    out = _repeat(rows, "k", 25_000).groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("draw").alias("d"), F.max("draw").alias("m"))
    assert {tuple(r) for r in out.collect()} == {(1, 25_001, 25_001, 25_000), (3, 1, 1, 0)}


def test_domain_of_the_nearest_source(lopsided):
    out = nearest_domain(lopsided, lopsided, ["a", "b"], "k", "k", "d")
    assert out.where("k <> neighbor OR distance > 0").count() == 0


def test_balance_report(lopsided):
    after = smote(lopsided, ["a", "b"], "y", "k")
    got = {(r["stage"], r["y"]): r["n"] for r in balance_report(lopsided, after, "y").collect()}
    assert got == {("before", 0): 160, ("before", 1): 40, ("after", 0): 160, ("after", 1): 160}


@pytest.fixture(scope="module")
def plain(spark):
    return spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("y"), F.lit(1.0).alias("a"), F.lit(1.0).alias("b"))


def test_noise_moments(plain):
    row = aug.add_noise(plain, ["a", "b"], "k").agg(F.avg("a"), F.stddev_pop("a"), F.corr("a", "b")).first()
    assert abs(row[0] - 1) < 0.002 and abs(row[1] - 0.05) < 0.002 and abs(row[2]) < 0.03


def test_mask_rates(plain):
    masked = aug.mask(plain, ["a", "b"], "k", 0.1)
    row = masked.agg(F.avg((F.col("a") == 0).cast("double")),
                     F.avg(((F.col("a") == 0) & (F.col("b") == 0)).cast("double"))).first()
    assert abs(row[0] - 0.1) < 0.01 and abs(row[1] - 0.01) < 0.004
    weighted = aug.mask(plain, ["a", "b"], "k", 0.4, importances={"a": 1.0, "b": 0.5})
    row = weighted.agg(F.min("a"), F.avg((F.col("b") == 0).cast("double"))).first()
    assert row[0] == 1.0 and abs(row[1] - 0.2) < 0.02
    whole = aug.mask(plain, ["a", "b"], "k", 0.5, mode="feature").select("a", "b").distinct().collect()
    assert len(whole) == 1
    with pytest.raises(ValueError):
        aug.mask(plain, ["a"], "k", 0.1, mode="row")


def test_augmented_twins_keep_their_key(plain):
    out = aug.augment(plain, ["a", "b"], "k")
    assert out.count() == 40_000 and out.where("copy = 0 AND a <> 1").count() == 0


@pytest.mark.parametrize("variant,want", [("a", [.05, .05, .055, .15, .15]), ("b", [.05, .05, .05, .1925, .2])])
def test_mask_schedule(spark, variant, want):
    df = spark.createDataFrame([(r,) for r in (0, 9, 10, 29, 30)], "r int")
    got = [r[0] for r in df.orderBy("r").select(aug.mask_probability(F.col("r"), variant)).collect()]
    assert got == pytest.approx(want)


def test_mixup(plain):
    out = aug.mixup(plain.withColumn("a", F.col("k").cast("double")), ["a"], "y", "k")
    assert out.count() == 40_000
    total = out.groupBy("k").agg(F.sum("weight").alias("w"), F.count_distinct("a").alias("n"))
    assert total.where("abs(w - 1) > 1e-9 OR n <> 1").count() == 0
    shares = [r[0] for r in out.where("draw = 0").select("weight").distinct().collect()]
    assert len(shares) == 5 and all(0 <= s <= 1 for s in shares)


def test_beta_draws(spark):
    from netweave.functions import row_words

    df = spark.range(20_000).select(aug.beta_draw(row_words("id"), 0.2, "t").alias("l"))
    mean, var = df.agg(F.avg("l"), F.var_pop("l")).first()
    assert abs(mean - 0.5) < 0.01 and abs(var - 0.25 / 1.4) < 0.005


def test_wide_vectors_equal_brute_force(spark, monkeypatch):
    """Six hundred columns, far from the origin, with ties: leading directions bound, and every pair is listed once."""
    from netweave.operators import neighbors

    rng = np.random.default_rng(10)
    flat = rng.normal(size=(420, 5)) @ rng.normal(size=(5, 600)) + rng.normal(size=(420, 600)) * 0.05 + 1000.0
    p = np.round(np.concatenate([flat, flat[:20] + 0.5, flat[:20] - 0.5]), 3)
    listed = []
    written = neighbors.materialize

    def spy(df, name):
        out = written(df, name)
        if name == "tile-pairs":
            listed.extend((r["leaf"], r["part"], r["block"]) for r in out.collect())
        return out

    monkeypatch.setattr(neighbors, "materialize", spy)
    monkeypatch.setattr(neighbors, "_NEAR_BLOCKS", 2)
    ids = np.arange(len(p))
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(p)], "k bigint, v array<double>")
    df = rows.select("k", *[F.col("v")[j].alias(f"x{j}") for j in range(600)])
    got = lists(nearest(df, None, [f"x{j}" for j in range(600)], "k", 5, block_rows=40))
    assert got == brute(p, p, ids, ids, 5, True)
    blocks = 16
    assert 0 < len(listed) == len(set(listed)) <= blocks * (blocks - 2)


@pytest.mark.parametrize("strip", [1, 16 << 20])
def test_blocks_of_many_tiles(spark, monkeypatch, strip):
    """Tiles of a few points and strips of one tile give the same neighbours."""
    from netweave.operators import neighbors

    monkeypatch.setattr(neighbors, "_CHUNK", 16)
    monkeypatch.setattr(neighbors, "STRIP_BYTES", strip)
    monkeypatch.setattr(neighbors, "_NEAR_BLOCKS", 1)
    rng = np.random.default_rng(11)
    p = rng.integers(0, 30, size=(300, 3)).astype(float)
    codes = [("ab"[i % 2],) for i in range(300)]
    got = lists(nearest(table(spark, p, codes=codes), None, ["x0", "x1", "x2"], "k", 4, ["c"], 2.0, block_rows=60))
    assert got == brute(p, p, np.arange(300), np.arange(300), 4, True, {i: codes[i] for i in range(300)}, codes, 2.0)


def test_neighbours_of_nothing(spark):
    none = table(spark, np.zeros((0, 2)))
    some = table(spark, np.ones((3, 2)))
    assert nearest(none, None, ["x0", "x1"], "k", 2).count() == 0
    assert nearest(some, none, ["x0", "x1"], "k", 2).count() == 0
    assert nearest(none, some, ["x0", "x1"], "k", 2).count() == 0


def test_tiles_are_met_several_at_a_time():
    """The first alone, which bounds the distances, then about a chunk of vectors; pairs within known radii are all found."""
    from netweave.operators import neighbors

    sizes = [70] * 100
    got = neighbors._batches(sizes)
    assert got[0] == slice(0, 1) and len(got) <= 6 and neighbors._batches([]) == []
    assert [i for s in got for i in range(100)[s]] == list(range(100))
    rng = np.random.default_rng(3)
    q, r = rng.normal(size=(40, 30)).round(1) + 1e3, rng.normal(size=(900, 30)).round(1) + 1e3
    exact = ((q[:, None] - r) ** 2).sum(-1)
    radius = np.sort(exact, axis=1)[:, 4]
    i, j = neighbors._within(q, r, 5, radius)
    assert {(a, b) for a, b in zip(*np.nonzero(exact <= radius[:, None]))} <= set(zip(i, j))
    assert neighbors._within(q, r, 1, np.full(40, 1e9)) is None and neighbors._within(q, r, 5, np.full(40, np.inf)) is None
