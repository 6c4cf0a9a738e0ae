"""Classifiers, near-duplicates, vectors, mixing and the pipeline against plain re-implementations."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from netweave.llm import components, embeddings, mixing, quality, queries, simhash, toxicity
from netweave.llm.base import crc_bucket
from netweave.session import materialize, small_table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, fp int, predicted int"


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or ""), "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# --- classifiers -----------------------------------------------------------------------

WORDS = "river stone garden morning letter window market winter people answer number silver travel little mother".split()


def labelled(spark, n=240, seed=3):
    """Every third text is junk in capitals; every fourth holds an insult next to a group."""
    rng = random.Random(seed)
    texts, rows = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(30, 90))]
        bad, toxic = i % 3 == 0, i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = "those fools"
        elif i % 4 == 1:
            words[rng.randrange(len(words))] = "fools"
        elif i % 4 == 2:
            words[rng.randrange(len(words))] = "those"
        text = " ".join(words)
        texts.append(re.sub(" ", "!!! ", text.upper()) if bad else text)
        rows.append((i, int(not bad), int(toxic)))
    return documents(spark, texts), small_table(spark, rows, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    keep = crc_bucket(F.col("doc_id"), 4) != 2
    model = quality.fit_quality(docs, labels, keep)
    held = quality.score_quality(docs, model).join(labels.where(~keep), "doc_id").collect()
    assert len(held) > 30 and np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in held)


def test_quality_scores_written_out(spark):
    """Scores from compression sizes taken with the library directly, one block after the other."""
    import zstandard

    docs, labels = labelled(spark)
    model = quality.fit_quality(docs, labels, F.lit(True))

    def size(raw, block):
        options = dict(level=quality.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        if raw:
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            made = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            made.precompute_compress(level=quality.LEVEL)
            options["dict_data"] = made
        return len(zstandard.ZstdCompressor(**options).compress(block))

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.limit(25).collect()}
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    for d, text in texts.items():
        blocks = [text[i:i + 1024] for i in range(0, len(text), 1024)] or [b""]
        sizes = [(size(model.good, b), size(model.bad, b), size(b"", b)) for b in blocks]
        g, b, n = (sum(x) for x in zip(*sizes))
        shares = [(x - y) / max(x, y) for x, y, _ in sizes]
        m = [(g - b) / max(g, b), (n - g) / max(n, g), (n - b) / max(n, b), max(shares), min(shares)]
        terms = m + [m[i] * m[j] for i in range(5) for j in range(i, 5)]
        z = model.weights[0] + sum(w * (t - a) / s for w, t, a, s in zip(model.weights[1:], terms, model.mean, model.scale))
        assert got[d] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_toxicity_scores_written_out(spark):
    """Scores with the sum over pairs of terms as a double loop."""
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    for r in docs.limit(25).collect():
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (r["text"] or "").encode().lower())
        held = sorted({model.places[t] for w in words for t in toxicity.terms(w) if t in model.places})
        z = model.constant + sum(model.weights[i] for i in held)
        z += sum(float(model.vectors[i] @ model.vectors[j]) for a, i in enumerate(held) for j in held[a + 1:])
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_quality_of_given_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = queries.QUERIES["op3_quality"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.8
    assert queries.QUERIES["op3_quality"](spark, sf).count() == docs.count()


def test_toxicity_needs_the_pair(spark):
    docs, labels = labelled(spark, 400)
    keep = crc_bucket(F.col("doc_id"), 5) != 0
    model = toxicity.fit_toxicity(docs, labels, keep)
    held = toxicity.score_toxicity(docs, model).join(labels.where(~keep), "doc_id").collect()
    assert len(held) > 40 and np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in held]) > 0.95
    assert np.abs(model.vectors).max() > 0.2


def test_machine_learns_interaction():
    """Neither term alone tells the classes apart."""
    x = np.array([[a, b] for a in (0, 1) for b in (0, 1)] * 50, np.float32)
    y = np.array([a ^ b for a in (0, 1) for b in (0, 1)] * 50, np.float64)
    constant, weights, vectors = toxicity._machine(x, y, np.ones(len(y)), steps=800)
    model = toxicity.ToxicityModel({0: 0, 1: 1}, constant, weights, vectors)
    assert [model.score(h) > 0.5 for h in ([], [0], [1], [0, 1])] == [False, True, True, False]


@pytest.mark.parametrize("fit, score, label", [
    (quality.fit_quality, quality.score_quality, "quality"), (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic")])
def test_classifier_edges(spark, fit, score, label):
    docs, labels = labelled(spark, 60)
    odd = documents(spark, [None, "", " ", "é\U0001f600" * 5, "word " * 20_000])
    always = F.lit(True)
    model = fit(docs, labels, always)
    again = fit(docs, labels, always)
    got = score(odd.union(odd), model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"]: r["score"] for r in got} == {r["doc_id"]: r["score"] for r in score(odd, again).collect()}
    for none in (labels.limit(0), labels.where(f"{label} = 1"), labels.withColumn(label, F.lit(None).cast("int")),
                 labels.union(labels.withColumn(label, 1 - F.col(label)))):
        share = {r["score"] for r in score(odd, fit(docs, none, always)).collect()}
        assert len(share) == 1 and 0 < share.pop() < 1
    assert score(odd.limit(0), fit(docs.limit(0), labels, always)).count() == 0
    bounded = fit(docs, labels, always, per_class=5, max_chars=400)
    assert score(docs, bounded).count() == 60
    with pytest.raises(ValueError):
        score(odd, model, keep=("doc_id", "score"))


# --- components ------------------------------------------------------------------------

def plain_roots(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    edges += [(200 + i, 201 + i) for i in range(30)] + [(300, 300 + i) for i in range(1, 40)] + edges[:5]
    table = small_table(spark, edges + [(None, 5), (7, None)], "a long, b long")
    got = [(r["node"], r["root"]) for r in components.components(table).collect()]
    want = {n: r for n, r in plain_roots([e for e in edges if e[0] != e[1]]).items()}
    assert len(got) == len(want) and dict(got) == want
    a, b = np.array(edges).T
    assert components.local_roots(400, a, b).tolist() == [plain_roots(edges).get(n, n) for n in range(400)]


def test_components_of_nothing(spark):
    assert components.components(small_table(spark, [(1, 1)], "a long, b long")).count() == 0


# --- near-duplicates ---------------------------------------------------------------------

def plain_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_texts(seed=1):
    rng = random.Random(seed)
    texts = [None, "", " \t", "one", "One two", "été\x85x y z", "a b c", "A  b\nC"]
    for _ in range(12):
        base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.choice((5, 80, 300)))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    return texts + texts[8:12]


@pytest.mark.parametrize("radius, tile", [(2, 2048), (3, 2), (0, 4)])
def test_near_duplicates_match_plain_search(spark, radius, tile):
    texts = near_texts()
    prints = [plain_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i, len(texts)) if (prints[i] ^ prints[j]).bit_count() <= radius]
    want = plain_roots(links)
    got = simhash.near_duplicates(documents(spark, texts), radius=radius, tile=tile).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == [
        (i, f"{p:016x}", want[i]) for i, p in enumerate(prints)]


def test_close_fingerprints_are_all_found(spark):
    """Fingerprints at every distance from one another, in many cells."""
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for p in prints[:120]:
        for _ in range(rng.randrange(1, 4)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    prints = sorted(set(prints))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.close_links(small_table(spark, signed, "fp long"), 2, 3).collect()
    got = plain_roots([(r["a"], r["b"]) for r in links])
    pairs = [(signed[i][0], signed[j][0]) for i in range(len(prints)) for j in range(i)
             if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert pairs and got == plain_roots(pairs)


def test_near_duplicates_edges(spark):
    assert simhash.near_duplicates(documents(spark, ["x"]).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (None, "q r s"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(nulls).collect()
                 if r["component_id"] is not None)
    assert [(n, c) for n, _, c in got] == [(False, 4), (False, 4), (True, 4)]
    long = "w " * 100_000 + "end"
    assert simhash.fingerprint(long.encode()) % (1 << 64) == plain_fingerprint(long)


# --- vectors -------------------------------------------------------------------------------

def plain_vectors(rows, threshold=0.93):
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = {}
    for n, (_, v, label) in enumerate(rows):
        if label is not None and good(v):
            x = np.array(v, np.float32).astype(np.float64)
            units[n] = x / np.linalg.norm(x)
    links = [(i, j) for i in units for j in units if i < j and rows[i][2] == rows[j][2]
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]
    count = collections.Counter(k for p in links for k in p)
    root = plain_roots(links)
    groups = collections.defaultdict(list)
    for n in range(len(rows)):
        groups[root.get(n, n)].append(rows[n][0])
    return [(rows[n][0], count[n], min(groups[root.get(n, n)])) for n in range(len(rows))]


@pytest.mark.parametrize("tile", [1024, 3])
def test_near_vectors_match_plain_search(spark, tile):
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        for _ in range(12):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 5)):
                rows.append((base + rng.normal(size=16) * 0.12, label))
    rows += [(rows[0][0], 0), (rows[0][0], 1), (rows[0][0], 0), (rows[0][0] * 3, 0), (rows[0][0][:8], 0), (rows[1][0][:8], 0)]
    rows = [([float(np.float32(x)) for x in v], label) for v, label in rows]
    rows += [(None, 0), ([], 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([float("inf")] + [1.0] * 15, 0),
             ([None] + [1.0] * 15, 0), ([-0.0] * 15 + [1.0], 0), ([0.0] * 15 + [1e-30], 0), ([1e30] + [0.0] * 15, 1)]
    rows = [(n, v, label) for n, (v, label) in enumerate(rows)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "n") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = embeddings.near_vectors(df, tile=tile).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted(plain_vectors(rows))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_error_bound_holds():
    """The bound covers what the int8 product is off, so no close pair is missed."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 24)) * np.exp(rng.normal(size=(300, 24)))
    x[150:] = x[:150] + rng.normal(size=(150, 24)) * 0.05
    u = embeddings._units(x)
    q, s, e = embeddings.quantised(u)
    rough = (q.astype(np.float64) @ q.T) * s[:, None] * s[None, :]
    assert (np.abs(rough - u @ u.T) <= e[:, None] + (1 + e)[:, None] * e[None, :] + 1e-12).all()
    for threshold in (0.5, 0.93, 0.999):
        i, j = embeddings.close_pairs(x, x, threshold, True)
        a, b = np.nonzero(np.triu(u @ u.T >= threshold, 1))
        assert set(zip(i, j)) == set(zip(a, b))


def test_near_vectors_of_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(df).count() == 0


# --- mixing ----------------------------------------------------------------------------------

def plain_targets(sizes, share=1.5, limit=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_ones, target = share * sum(sizes.values()), set(order), {}
    while open_ones:
        total = sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if weight[s] * left / total > limit * sizes[s]}
        if not full:
            return target | {s: weight[s] * left / total for s in open_ones}
        for s in full:
            target[s] = limit * sizes[s]
        left = share * sum(sizes.values()) - sum(target.values())
        open_ones -= full
    return target


def mixable(spark, n=900):
    rng = random.Random(8)
    names = ["b", "a", "Z", "é", "\U0001f600", None, "aa", ""]
    texts, sources = [], []
    for _ in range(n):
        sources.append(rng.choice(["b", "b", "b", *names]))
        texts.append(rng.choice([None, "", "x y", "w\t" * rng.randrange(1, 400), " w" * rng.randrange(1, 40)]))
    return documents(spark, texts, sources), texts, sources


@pytest.mark.parametrize("leaf, fan", [(20_000, 32), (20, 3)])
def test_mixing(spark, leaf, fan):
    docs, texts, sources = mixable(spark)
    got = mixing.mix_sources(docs, leaf=leaf, fan=fan).collect()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    sizes = collections.Counter()
    for s, w in zip(sources, words):
        sizes[s] += w
    target, taken = plain_targets(dict(sizes)), collections.Counter()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for r in got:
        s = sources[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[s]
        assert abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 2 * r["size"]
        share = target[s] / sizes[s] if sizes[s] else 0
        assert not r["size"] or int(share) <= r["copies"] <= -(-share // 1)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(40, 0.02 * target[s])
    again = mixing.mix_sources(docs.repartition(5), leaf=leaf, fan=fan).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in got}


def test_trades_keep_words_and_expectation():
    rng = np.random.default_rng(0)
    size = np.array([3.0, 50, 7, 1, 400, 9, 30, 2, 8, 120])
    share = np.array([0.3, 0.6, 0.5, 0.2, 0.35, 0.8, 0.5, 0.5, 0.1, 0.7])
    total = np.zeros(len(size))
    for _ in range(4000):
        mass = size * share
        mixing.trade(size, mass, [4, 9, 1, 6], rng)
        assert abs(mass.sum() - (size * share).sum()) < 1e-6
        mixing.settle(size, mass, rng)
        assert all(m in (0, s) or min(m, s - m) < 1e-6 for m, s in zip(mass, size))
        total += mass / size
    assert np.abs(total / 4000 - share).max() < 0.035


def test_mixing_edges(spark):
    docs, _, _ = mixable(spark, 3)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a b c", "s")] * 9 + [(None, "d e", None)] * 3, "doc_id long, text string, source string")
    got = mixing.mix_sources(same).collect()
    assert len(got) == 12 and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    empty = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix_sources(empty).collect()] == [(0.0, 0), (0.0, 0)]
    counts = mixing.word_counts(pa.array(["", "a", " a", "a ", "é b\x0bc", "\x85", "", "a\x1cb"]))
    assert counts.tolist() == [0, 1, 1, 1, 3, 1, 0, 1]


def test_mixed_documents(spark):
    docs, _, _ = mixable(spark, 200)
    odd = docs.withColumn("copies", F.lit(7)).withColumn("_source", F.lit("q"))
    got = mixing.mixed_documents(odd).collect()
    n = collections.Counter(r["doc_id"] for r in got)
    assert set(n.values()) <= {1, 2} and all(r["copies"] == 7 for r in got)
    assert all({r["copy"] for r in got if r["doc_id"] == d} == set(range(1, n[d] + 1)) for d in n)


def mixed_rows(df):
    got = mixing.mixed_documents(df)
    return sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=repr)


def test_mix_does_not_depend_on_the_layout(spark):
    docs, _, _ = mixable(spark, 400)
    docs = docs.withColumn("extra", F.col("doc_id") % 3)
    odd = docs.unionByName(docs.where("doc_id % 5 = 0")).unionByName(docs.where("doc_id % 10 = 0").withColumn("extra", F.lit(9)))
    odd = odd.unionByName(odd.limit(30).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("same four words here")))
    odd = materialize(odd, "odd")
    want = mixed_rows(odd)
    assert mixed_rows(odd.repartition(7, "text")) == want == mixed_rows(odd.orderBy(F.desc("doc_id")).coalesce(1))
    named = mixing.mixed_documents(odd.withColumn("copy", F.lit(1)).withColumn("_id", F.lit(2)))
    assert named.columns == [*odd.columns, "copy", "_id", "copy_"] and named.count() == len(want)


# --- the pipeline ------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf):
    """Every stage against what its operator says about its input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, columns = docs, docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf).cache()
        seen[name] = (docs, after)
        assert name == "mix" or after.columns == columns
        docs = after
    before, after = seen["quality"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    assert before.join(labels, "doc_id").join(after, "doc_id", "left_anti").count() <= 0.05 * labels.count()
    before, after = seen["deduplicate"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    ids = sorted(prints)
    root = plain_roots([(a, b) for a in ids for b in ids if a <= b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(set(root.values()))
    before, after = seen["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = set()
    for _, t in items:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        grams |= {" " + " ".join(w[i:i + 10]) + " " for i in range(max(1, len(w) - 9))}

    def clean(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        line = f" {' '.join(w)} "
        return not any(g in line for g in grams)

    want = sorted(r["doc_id"] for r in before.collect() if clean(r["text"]))
    assert sorted(r["doc_id"] for r in after.collect()) == want
    before, after = seen["redact"]
    assert after.count() == before.count()
    assert not [r for r in after.collect() if re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r["text"] or "")]
    before, after = seen["mix"]
    kept = after.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m"))
    assert kept.where("n <> m or n > 2").count() == 0 and after.columns == [*columns, "copy"]
    assert {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in before.collect()}
    assert start.count() > seen["mix"][0].count()


def test_deduplicate_keeps_one_of_repeated_rows(spark, sf):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "other words here"), (None, "other words here"), (3, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.deduplicate(spark, docs, sf).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in got) == [
        (False, 1, "a b c d"), (False, 2, ""), (True, None, "other words here")]


def test_pipeline_keeps_odd_columns(spark, sf):
    """Nulls in every column, repeated rows, and columns named as the operators name theirs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = docs.select(*[F.when(F.col("doc_id") % (7 + i) != 0, F.col(c)).alias(c) for i, c in enumerate(docs.columns)])
    more = ("a.b", "score", "spans", "hits", "items", "_text", "_c0", "fp", "size", "node", "n_words", "component_id", "copies", "copy", "_row", "_null",
            "_id", "_dedup_row", "_mix_row")
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(more)])
    docs = docs.union(docs.limit(5))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "odd")
        assert docs.columns == (names if name != "mix" else [*names, "copy_"])
        assert docs.count() and [docs.select(f"`{c}`").distinct().collect() for c in more] == [[(i,)] for i in range(len(more))]


def test_pipeline_over_two_layouts(spark, sf, tmp_path):
    """The same documents in other files make the same corpus, and only the last stage's table is left."""
    import os
    import shutil

    from netweave import session

    for name in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.desc("n_chars")).repartition(5).write.parquet(
        str(tmp_path / "documents.parquet"))
    got = []
    for folder in (sf, str(tmp_path)):
        before = set(session._written)
        out = corpus_pipeline.run(spark, folder)
        assert len(set(session._written) - before) == 1
        got.append(sorted(map(tuple, out.select("doc_id", "copy", "text").collect())))
    assert got[0] == got[1] and got[0] and os.path.isdir(sf)


def test_pipeline_of_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_strips_of_many_tiles(spark, monkeypatch):
    """However long the strips are, every pair of tiles is compared once."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(40, 8))
    points = np.repeat(base, 6, axis=0) + rng.normal(size=(240, 8)) * 0.08
    df = spark.createDataFrame(
        [(i, i % 2, [float(v) for v in p]) for i, p in enumerate(points)], "vec_id long, label long, embedding array<double>")

    def answer():
        return sorted(tuple(r) for r in embeddings.near_vectors(df, tile=16).collect())

    short = answer()
    monkeypatch.setattr(embeddings, "_SIDE", 3)
    assert answer() == short and sum(r[1] for r in short) > 100
    monkeypatch.setattr(embeddings, "_SIDE", 1)
    assert answer() == short
