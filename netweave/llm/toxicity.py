"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words, letters A-Z lowered, and their beginnings of four to six bytes,
each hashed to a number.  The fit keeps the numbers that tell the classes apart best in a
bounded labelled sample; a text is then the set of those it holds.  Besides a weight, each
has a short vector, and a pair of terms adds the product of their vectors, so the model
learns that two words say more together than their weights add up to.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from netweave.llm.base import each_bytes, label_sample, over_texts
from netweave.llm.words import words_of

BUCKETS = 1 << 20
STEMS = (4, 5, 6)
#: Bounds of the fit: labelled documents of each class, characters of one, and terms kept.
PER_CLASS = 4_000
MAX_CHARS = 50_000
TERMS = 1_024
FACTORS = 6
#: Words remembered as holding no kept term by one worker; forgotten together when there are more.
MEMO_WORDS = 500_000


def terms(word: bytes) -> set[int]:
    """The hashed terms of a word."""
    out = {crc32(b"w" + word) % BUCKETS}
    out.update(crc32(b"s%d" % n + word[:n]) % BUCKETS for n in STEMS if len(word) > n)
    return out


@dataclass(frozen=True)
class ToxicityModel:
    """Kept terms and their places, the constant, weights (terms) and vectors (terms x factors)."""

    places: dict[int, int]
    constant: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, held: list[int]) -> float:
        v = self.vectors[held]
        total = v.sum(0)
        z = self.constant + self.weights[held].sum() + 0.5 * float((total * total).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _machine(x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int = 7, steps: int = 250, rate: float = 0.05,
             ridge: float = 2e-5, factors: int = FACTORS) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit a factorization machine on a 0/1 matrix by Adam on the whole sample."""
    rng = np.random.default_rng(seed)
    share = float((w * y).sum() / w.sum())
    params = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(x.shape[1], np.float32),
              rng.normal(0, 0.05, (x.shape[1], factors)).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    w = (w / w.sum()).astype(np.float32)
    for t in range(1, steps + 1):
        c, a, v = params
        xv = x @ v
        z = c[0] + x @ a + 0.5 * ((xv * xv).sum(1) - x @ (v * v).sum(1))
        g = w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y.astype(np.float32))
        gx = g @ x
        grads = [np.array([g.sum()], np.float32), gx + ridge * a, x.T @ (g[:, None] * xv) - gx[:, None] * v + ridge * v]
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            params[i] = params[i] - rate * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-8)
    return float(params[0][0]), params[1].astype(np.float64), params[2].astype(np.float64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", key: str = "doc_id",
                 text: str = "text", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS,
                 kept_terms: int = TERMS) -> ToxicityModel:
    """Fit on at most ``per_class`` documents of each label, none longer than ``max_chars``.

    ``keep`` says which rows of ``labels`` may be learnt from.  With one class only, or none,
    every text scores the share of that class, or one half.
    """
    sample, counts = label_sample(docs, labels, label, keep, per_class, max_chars, key, text)

    def hashed(texts: pa.Array):
        rows = [sorted(set().union(*map(terms, set(words_of(t))))) for t in each_bytes(texts)]
        return [pa.array(rows, pa.list_(pa.int32()))]

    # Bounded: at most two classes of ``per_class`` rows of at most ``max_chars`` characters.
    table = over_texts(sample, "_text", ["_key", "_label"], "terms array<int>", hashed).toArrow()
    order = np.argsort(np.array([str(k) for k in table["_key"].to_pylist()], dtype=object), kind="stable")
    y = np.array(table["_label"].to_pylist(), dtype=np.float64)[order]
    rows = table["terms"].combine_chunks()
    held = [rows[int(i)].values.to_numpy() for i in order]
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else 0.001 + 0.998 * float(y[0])
        return ToxicityModel({}, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, 1)))
    df = [np.bincount(np.concatenate([h for h, v in zip(held, y) if v == c] or [np.zeros(0, np.int64)]),
                      minlength=BUCKETS) for c in (0, 1)]
    n = [float((y == c).sum()) for c in (0, 1)]
    p = [(d + 0.5) / (m + 1) for d, m in zip(df, n)]
    pooled = (df[0] + df[1] + 1) / (n[0] + n[1] + 2)
    chi = (p[1] - p[0]) ** 2 / (pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    chi[df[0] + df[1] < 3] = 0
    best = np.argsort(-chi, kind="stable")[:kept_terms]
    best = best[chi[best] > 4]
    places = {int(b): i for i, b in enumerate(best)}
    x = np.zeros((len(y), max(len(best), 1)), np.float32)
    for i, h in enumerate(held):
        x[i, [places[t] for t in h.tolist() if t in places]] = 1
    total = sum(counts.values())
    w = np.where(y == 1, counts[1] / total / n[1], counts[0] / total / n[0])
    constant, weights, vectors = _machine(x, y, w)
    return ToxicityModel(places, constant, weights, vectors)


class Scorer:
    """A model with the words met so far."""

    def __init__(self, model: ToxicityModel):
        self.model, self.plain, self.telling = model, set(), {}

    def score(self, text: bytes) -> float:
        held: set[int] = set()
        for word in set(words_of(text)) - self.plain:
            found = self.telling.get(word)
            if found is None:
                found = [self.model.places[t] for t in terms(word) if t in self.model.places]
                if found:
                    if len(self.telling) > MEMO_WORDS:
                        self.telling.clear()
                    self.telling[word] = found
                else:
                    if len(self.plain) > MEMO_WORDS:
                        self.plain.clear()
                    self.plain.add(word)
            held.update(found)
        return self.model.score(sorted(held))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep=("doc_id",), text: str = "text",
                   out: str = "score") -> DataFrame:
    """The kept columns and the probability ``out`` that a text is toxic; null and empty texts get one too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``kept_terms`` weights and vectors

    def score(texts: pa.Array, scorer: Scorer):
        return [pa.array([scorer.score(t) for t in each_bytes(texts)], pa.float64())]

    return over_texts(docs, text, list(keep), f"{out} double", score, lambda: Scorer(shared.value))
