"""A compression classifier of text quality.

Two zstandard dictionaries are built, one from good and one from bad labelled texts.  A
text is compressed block by block with either dictionary and with none; what counts is how
much smaller one dictionary makes it, as a share of the compressed size (over the whole text,
and of its most telling blocks).  A logistic calibration, fitted on labelled texts that the
dictionaries have not seen and weighted to the class shares of all labels, turns these
normalised differences into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame

from netweave.llm.base import each_bytes, label_sample, over_texts

BLOCK = 1024
DICTIONARY = 65_536
LEVEL = 3
#: Bounds of the fit: labelled documents of each class, and characters of one of them.
PER_CLASS = 3_000
MAX_CHARS = 50_000
#: Size differences of a text.
MEASURES = 5


class Compressors:
    """The compressors of a model, ready to use; made in each task since they cannot be sent."""

    def __init__(self, good: bytes, bad: bytes):
        def make(raw: bytes | None):
            options = dict(level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
            if raw is None:
                return zstandard.ZstdCompressor(**options)
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            trained = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            trained.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=trained, **options)

        self.good, self.bad, self.plain = make(good or None), make(bad or None), make(None)

    def measures(self, text: bytes) -> list[float]:
        """Normalised size differences of a text: whole against either dictionary and none, and of its most telling blocks."""
        good = bad = plain = 0
        low, high = 1.0, -1.0
        for i in range(0, max(len(text), 1), BLOCK):
            block = text[i:i + BLOCK]
            g, b = len(self.good.compress(block)), len(self.bad.compress(block))
            good, bad, plain = good + g, bad + b, plain + len(self.plain.compress(block))
            share = (g - b) / max(g, b)
            low, high = min(low, share), max(high, share)
        return [(good - bad) / max(good, bad), (plain - good) / max(plain, good), (plain - bad) / max(plain, bad), high, low]


def expand(rows: np.ndarray) -> np.ndarray:
    """The measures, their squares and their products."""
    n = rows.shape[1]
    pairs = [rows[:, i] * rows[:, j] for i in range(n) for j in range(i, n)]
    return np.column_stack([rows, *pairs])


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, measures: np.ndarray) -> np.ndarray:
        z = (expand(measures) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)))


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; for too few samples the texts themselves."""
    blocks = [t[i:i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-4, steps: int = 60) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method, the constant first."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * w.sum())
    penalty[0] = 1e-9 * w.sum()

    def loss(b):
        z = a @ b
        return (w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * b * b).sum()

    now = loss(beta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (w * (p - y)) + penalty * beta
        hessian = a.T @ (a * (w * p * (1 - p))[:, None]) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        rate = 1.0
        while rate > 1e-4 and loss(beta - rate * step) > now:
            rate /= 2
        beta, before = beta - rate * step, now
        now = loss(beta)
        if before - now <= 1e-9 * abs(before):
            break
    return beta


def fit_quality(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", key: str = "doc_id",
                text: str = "text", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> QualityModel:
    """Fit on at most ``per_class`` documents of each label, none longer than ``max_chars``.

    ``keep`` says which rows of ``labels`` may be learnt from.  With one class only, or none,
    every text scores the share of that class, or one half.
    """
    sample, counts = label_sample(docs, labels, label, keep, per_class, max_chars, key, text)
    rows = sorted((r["_label"], str(r["_key"]), r["_text"].encode()) for r in sample.collect())
    sides = {v: [t for y, _, t in rows if y == v] for v in (0, 1)}
    width = len(expand(np.zeros((1, MEASURES)))[0])
    if not sides[0] or not sides[1]:
        share = 0.5 if not rows else 0.001 + 0.998 * float(bool(sides[1]))
        return QualityModel(b"", b"", np.zeros(width), np.ones(width),
                            np.concatenate([[np.log(share / (1 - share))], np.zeros(width)]))
    seen = {v: ts[0::3] if len(ts) > 2 else ts for v, ts in sides.items()}
    rest = {v: [t for i, t in enumerate(ts) if i % 3] if len(ts) > 2 else ts for v, ts in sides.items()}
    good, bad = _dictionary(seen[1]), _dictionary(seen[0])
    tools = Compressors(good, bad)
    texts = rest[0] + rest[1]
    y = np.concatenate([np.zeros(len(rest[0])), np.ones(len(rest[1]))])
    total = sum(counts.values())
    w = np.where(y == 1, counts[1] / total / len(rest[1]), counts[0] / total / len(rest[0])) * len(y)
    x = expand(np.array([tools.measures(t) for t in texts]))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return QualityModel(good, bad, mean, scale, calibrate((x - mean) / scale, y, w))


def score_quality(docs: DataFrame, model: QualityModel, keep=("doc_id",), text: str = "text",
                  out: str = "score") -> DataFrame:
    """The kept columns and the probability ``out`` that a text is good; null and empty texts get one too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY bytes

    def score(texts: pa.Array, tools: Compressors):
        rows = np.array([tools.measures(t) for t in each_bytes(texts)]).reshape(-1, MEASURES)
        return [pa.array(shared.value.score(rows), pa.float64())]

    return over_texts(docs, text, list(keep), f"{out} double", score,
                      lambda: Compressors(shared.value.good, shared.value.bad))
