"""Spelling variants, filter audit and language model against plain re-implementations."""

import itertools
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netweave.llm import audit, lm, spelling
from netweave.llm.base import crc_bucket

DOCS = "doc_id long, text string, lang string, source string, word string, n long, h string, form string, id int, part string"


def documents(spark, rows):
    """Documents (id, text, source) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, "w", 7, "h", "f", 1, "p") for i, t, s in rows], DOCS)


# --- spelling ----------------------------------------------------------------------------

def plain_vocabulary(rows):
    counts = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def plain_groups(rows):
    words = plain_vocabulary(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def spelling_rows():
    rng = random.Random(3)
    stems = ["".join(rng.choice("abé") for _ in range(rng.choice([6, 7]))) for _ in range(120)]
    long = "".join(rng.choice("abcdefgh") for _ in range(3000))
    rows = [(None, None, None), (1, "", "s"), (2, "short words only", "s"), (3, "ÀÉÎÕÜß " * 7 + "×÷ÿÿÿÿ " * 5, "s"),
            (4, (long + " ") * 30 + (long[:1500] + long[1501:] + " ") * 5 + (long[:9] + "z" + long[10:] + "1") * 6, "s"),
            (5, "Program " * 200 + "PROGRAMS " * 30 + "programss\n" * 6 + "prograns " * 6 + "proram!" * 5, "s"),
            (None, "program Program", "s"), (5, "banana banane " * 3, "s"), (5, "banana banane " * 3, "s")]
    for i in range(300):
        rows.append((100 + i, " ".join(rng.choices(stems, k=40)) + rng.choice([" ", ". ", "9"]) * 3 + "Word", None))
    return rows


@pytest.mark.parametrize("limit", [spelling.BATCH_BLOCKS, 1])
def test_spelling_groups(spark, limit):
    rows = spelling_rows()
    got = spelling.spelling_groups(documents(spark, rows), limit=limit)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    want = plain_groups(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a form that has a form


def test_spelling_of_nothing(spark):
    none = documents(spark, [(1, None, "s")])
    assert spelling.spelling_groups(none).collect() == []
    assert spelling.spelling_groups(none.limit(0)).collect() == []


def test_batches_hold_every_word():
    counts = {6: 1000, 7: 31, 8: 33, 300: 1}
    for limit in (1, 3, 1 << 20):
        batches = spelling.plan_batches(counts, limit)
        assert all(sum(size for _, _, size in b.values()) <= limit for b in batches)
        shards = [shard for b in batches for shard in b]
        assert len(shards) == len(set(shards))
        for length in counts:
            parts = {b[(n, p)][0] for b in batches for n, p in b if n == length}
            assert len(parts) == 1 and sum(n == length for n, _ in shards) == parts.pop()


def test_edit_hashes_are_those_of_the_edited_words():
    words = ["banana", "cabbage"]
    for word in words:
        signs = np.array([ord(c) for c in "abcdz"], np.uint64)
        want = {word[:i] + word[i + 1:] for i in range(len(word))}
        want |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in "abcdz" if c > word[i]}
        got = np.concatenate([h for _, h, _ in spelling.edits(spelling.letters_of([word], len(word)), signs)])
        assert set(got.tolist()) == set(spelling.word_hashes(sorted(want))[0].tolist())


# --- audit -------------------------------------------------------------------------------

def plain_audit(rows, labels):
    texts = {}
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""] = min(texts.get(t or "", i), i)
    facts = []
    for i, t, s in rows:
        t = t or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = {f for f, bad in zip("ABCDE", [
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search("[#$%&*|]", t)), i is not None and texts[t] < i]) if bad}
        facts.append((s or "", fails, any(q == 1 for k, q, _ in labels if k == i and i is not None),
                      any(x == 1 for k, _, x in labels if k == i and i is not None)))
    out = {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f[1] for f in mine) - len(gone), sum(f[1] == {name} for f in mine),
                    sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def audit_rows():
    rng = random.Random(5)
    rows = [(None, None, None), (1, "", ""), (2, None, "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "a b", "x"), (4, "a b", None),
            (5, "ÀÉ" * 100, "x"), (6, " ".join("abc"), "x"), (7, " \x0b lead and trail \x0c", "y")]
    for i in range(60):
        words = [rng.choice(["One", "two", "three", "#", "Four", f"w{j}"]) for j in range(rng.choice([5, 250, 400]))]
        rows.append((100 - i, " ".join(words), rng.choice(["x", "y", None])))
    rows += [(200 + i, rows[20][1], "x") for i in range(9)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 210, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    return rows, labels


def test_audit(spark):
    rows, labels = audit_rows()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit_filters(documents(spark, rows), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                           "toxic_lost", "shapley"]
    want = plain_audit(rows, labels)
    found = {tuple(r)[:3]: list(r)[3:] for r in got.collect()}
    assert found == want and len(found) == 600 * 3
    empty = documents(spark, rows).limit(0)
    assert audit.audit_filters(empty, marks).collect() == []
    unlabelled = audit.audit_filters(documents(spark, rows[:3]), marks.limit(0))
    assert unlabelled.agg(F.max("good_lost"), F.max("toxic_lost")).first() == (0, 0)


def test_audit_takes_other_rules(spark):
    rows, labels = audit_rows()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = ("PQ", lambda body: (len(body) > 10, b"a" in body))
    got = audit.audit_filters(documents(spark, rows), marks, rules=rules, copies=None).where("part = 'x'").collect()
    assert {r["filter_order"] for r in got} == {"PQ", "QP"}
    first = {r["filter_order"]: r for r in got if r["step"] == 1}
    last = {r["filter_order"]: r for r in got if r["step"] == 2}
    assert first["PQ"]["shapley"] == first["PQ"]["removed"] + last["QP"]["removed"]


# --- language model ------------------------------------------------------------------------

def plain_tokens(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().translate(low)) if w] + [None]


def lm_rows():
    rng = random.Random(9)
    rows = [(None, None, "s"), (1, "", "s"), (2, " \n\t ", "s"), (3, "One", "s"), (4, "x" * 3_000_000 + " y", "s"), (4, "ONE one", "s"),
            (5, "the " * 5000, "s"), (5, "the " * 5000, "s"), (6, "nul\x00byte nul é É", "s")]
    pairs = ["the cat sat on a mat", "la casa de la playa", "ein hund und eine katze", "rare"]
    for i in range(400):
        rows.append((10 + i, " ".join(rng.choice(pairs) for _ in range(rng.randint(1, 30))) + f" odd{i} odd{i // 2}", "s"))
    return rows


def lm_wanted(rows):
    counts = Counter()
    held = [crc32(str(i).encode()) % 5 == 1 if i is not None else True for i, _, _ in rows]
    for (i, t, _), out in zip(rows, held):
        if not out:
            counts.update(plain_tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, t, _), h in zip(rows, held):
        words = plain_tokens(t)
        out.append((i, h, len(words), sum(counts[w] > 0 for w in words), n,
                    round(sum(math.log10((counts[w] + .5) / (n + .5 * (v + 1))) for w in words), 6)))
    return sorted(out, key=repr)


def scored(spark, rows, **options):
    return lm.score_texts(documents(spark, rows), crc_bucket(F.col("doc_id"), 5) != 1, **options).collect()


def facts(got):
    return sorted([(*tuple(r)[:5], round(r["base_score"], 6)) for r in got], key=repr)


def test_lm_counts_and_scores(spark):
    rows = lm_rows()
    got = scored(spark, rows)
    assert facts(got) == lm_wanted(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] != 5]  # one word over and over is new to the model
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] <= 0 for r in got)
    # The plan does not show: other buckets, words dealt by slice or not.
    hasher = lm.Hasher()
    marked = [int(hasher.tokens(pa.array([w]))[0][0]) for w in ("the", "rare", "never")]
    for options in (dict(buckets=3, hot=marked), dict(buckets=1, hot=[])):
        other = scored(spark, rows, **options)
        assert facts(other) == facts(got)
        a, b = sum(r["score"] for r in got), sum(r["score"] for r in other)
        assert abs(a - b) < 0.02 * abs(a)
    again = scored(spark, rows)
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["score"])
    assert [round(r["score"], 6) for r in sorted(again, key=key)] == [round(r["score"], 6) for r in sorted(got, key=key)]


def test_lm_of_nothing(spark):
    assert scored(spark, lm_rows()[:0]) == []
    only_held = scored(spark, [(None, "a b", "s"), (None, None, "s")])
    assert facts(only_held) == lm_wanted([(None, "a b", "s"), (None, None, "s")])
    assert all(math.isfinite(r["score"]) for r in only_held)


def test_tokens_of_pieces():
    texts = ["ab  cd", "", "CD\n", "ab", " ", "é" * 5]
    hasher = lm.Hasher()
    token, before, owner = hasher.tokens(pa.array(texts))
    assert np.bincount(owner, minlength=6).tolist() == [3, 1, 2, 2, 1, 2]
    ab, cd = token[0], token[1]
    assert token.tolist()[:8] == [ab, cd, lm.END, lm.END, cd, lm.END, ab, lm.END]
    starts = int(lm.START >> np.uint64(48))
    assert before[[0, 3, 4, 6]].tolist() == [starts] * 4 and before[1] == int(ab >> np.uint64(48))
    old = lm.PIECE
    try:
        lm.PIECE = 8
        many = [f"word{i} " * 3 + "longerthanapiece" * (i % 3) for i in range(50)]
        small = lm.Hasher().tokens(pa.array(many))[0]
    finally:
        lm.PIECE = old
    assert small.tolist() == lm.Hasher().tokens(pa.array(many))[0].tolist()


def test_pack():
    columns = [np.arange(5, dtype=np.uint16), np.zeros(0, np.int64), np.array([2**60], np.uint64)]
    assert [c.tolist() for c in lm.unpack(lm.pack(*columns))] == [c.tolist() for c in columns]


@pytest.mark.parametrize("customers, weight, discount", [(3, 0.4, 0.5), (6, 0.1, 0.8), (7, 2.0, 0.3)])
def test_seating_reaches_the_exact_distribution(customers, weight, discount):
    """Tables of one dish: in proportion to weight**t times the generalised Stirling number."""
    rows = [0.0, 1.0]
    for n in range(1, customers):
        rows = [0.0] + [(rows[t] if t < len(rows) else 0.0) * (n - discount * t) + rows[t - 1] for t in range(1, n + 2)]
    want = np.array([rows[t] * weight ** t for t in range(1, customers + 1)])
    want /= want.sum()
    rng = np.random.default_rng(1)
    n = 40_000
    c, a = np.full(n, customers), np.full(n, weight)
    tables, logs = lm.seat(c, a, discount, rng)
    for _ in range(12):
        new, fresh = lm.seat(c, a, discount, rng)
        taken = np.log(rng.random(n)) < fresh - logs
        tables, logs = np.where(taken, new, tables), np.where(taken, fresh, logs)
    got = np.bincount(tables, minlength=customers + 1)[1:] / n
    assert np.abs(got - want).max() < 0.012


def test_parties_seat_many_customers():
    rng = np.random.default_rng(2)
    tables, _ = lm.seat(np.full(200, 10**9), np.full(200, 5.0), 0.0, rng)
    # Without a discount the tables follow weight * log(customers / weight).
    assert abs(tables.mean() / (5 * math.log(1e9 / 5)) - 1) < 0.15


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(4)
    words, classes = 50, 4
    table = np.unique(rng.integers(0, words, 400) * classes + rng.integers(0, classes, 400), return_counts=True)
    word, klass, customers = table[0] // classes, table[0] % classes, table[1].astype(np.int64)
    a, b = (lm._by_class(v, klass) for v in (customers, np.ones(len(klass))))
    totals = lm.Totals(int(customers.sum()), len(np.unique(word)), a, b, 0.6, 0.4)
    for tables, above, parent in lm.seatings(word, klass, customers, words, totals, (1, 2)):
        assert (tables <= customers).all() and (tables >= 1).all() and (parent <= above).all()
        s = lm.Sample(lm._by_class(tables, klass), above.sum(), parent.sum())
        for k in (0, 1, 2, 3, 9):
            full, spread = np.zeros(words + 1, np.int64), np.zeros(words + 1, np.int64)
            full[word[klass == k]], spread[word[klass == k]] = customers[klass == k], tables[klass == k]
            p = lm.probability(np.arange(words + 1), np.full(words + 1, k), full, spread, np.append(above, 0),
                               np.append(parent, 0), totals, s)
            known = np.append(np.isin(np.arange(words), word), True)
            assert abs(p[known].sum() - 1) < 1e-9
