"""Learners on ``pyspark.ml``: base models, stacking, reweighted refits, importances.

Training tables are written once as (key, label, features) rows, so that the many
passes of a fit read a narrow table instead of repeating the preprocessing.
Boosted trees with penalties on leaf values and the net with rectified layers, dropout and
focal loss are this library's own (:mod:`netweave.operators.boosting` and
:mod:`netweave.operators.dense`).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.operators.boosting import BoostSettings, PenalisedBoost, PenalisedBoostModel, fit_settings
from netweave.operators.dense import FocalNet, NetSettings, packed_rows
from netweave.operators.metrics import evaluate, macro_metrics
from netweave.operators.sampling import with_fold
from netweave.operators.weights import (
    WeightSchedule,
    class_weights,
    focal_loss,
    momentum_update,
    weight_map,
    with_weight,
)
from netweave.session import materialize, small_table

FEATURES = "features"
_META, _NAMES = "_meta", "_names"


def to_vectors(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` plus one feature vector, from plainly named columns."""
    safe = df.select(*keep, *[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    inputs = [f"f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="error").transform(safe).select(
        *keep, FEATURES)


def positive_probability(name: str = "probability") -> Column:
    return vector_to_array(F.col(name))[1]


def score(model: Model, df: DataFrame, out: str = "score") -> DataFrame:
    """Add the model's probability of class 1."""
    scored = model.transform(df)
    return scored.select(*df.columns, positive_probability().alias(out))


# --- base learners -----------------------------------------------------------------

def focal_net(weight: str | None = None, key: str | None = None, **settings) -> FocalNet:
    """A net with rectified layers and focal loss; options are fields of ``NetSettings``."""
    return FocalNet(NetSettings(**settings), key, weight)


def dense_net(width: int, hidden: Sequence[int] = (64, 32), iterations: int = 50, seed: int = 42) -> Estimator:
    return MultilayerPerceptronClassifier(labelCol="label", featuresCol=FEATURES, layers=[width, *hidden, 2],
                                          maxIter=iterations, seed=seed)


def boosted_trees(trees: int = 100, depth: int = 6, rate: float = 0.1, rows: float = 0.8, cols: float = 0.8,
                  min_rows: int = 1, weight: str | None = None, seed: int = 42) -> Estimator:
    model = GBTClassifier(labelCol="label", featuresCol=FEATURES, maxIter=trees, maxDepth=depth, stepSize=rate,
                          subsamplingRate=rows, featureSubsetStrategy=str(cols), minInstancesPerNode=min_rows, seed=seed)
    return model.setWeightCol(weight) if weight else model


def penalised_trees(weight: str | None = None, key: str | None = None, **settings) -> PenalisedBoost:
    """Boosted trees with L1 and L2 penalties on their leaves; options are fields of ``BoostSettings``."""
    return PenalisedBoost(BoostSettings(**settings), key, weight)


def logistic(weight: str | None = None, penalty: float = 0.0, mix: float = 0.0, iterations: int = 100) -> Estimator:
    model = LogisticRegression(labelCol="label", featuresCol=FEATURES, regParam=penalty, elasticNetParam=mix,
                               maxIter=iterations)
    return model.setWeightCol(weight) if weight else model


def forest(trees: int = 100, depth: int = 10, weight: str | None = None, seed: int = 42) -> Estimator:
    model = RandomForestClassifier(labelCol="label", featuresCol=FEATURES, numTrees=trees, maxDepth=depth,
                                   featureSubsetStrategy="sqrt", seed=seed)
    return model.setWeightCol(weight) if weight else model


def default_bases(width: int, seed: int = 42) -> dict[str, Estimator]:
    """Four different learners stand in for four networks."""
    return {
        "p_a": focal_net(seed=seed),
        "p_b": logistic(penalty=1e-4),
        "p_c": forest(trees=20, depth=8, seed=seed),
        "p_d": penalised_trees(trees=20, depth=4, seed=seed),
    }


# --- stacking ----------------------------------------------------------------------

def mean_score(cols: Sequence[str]) -> Column:
    """Plain average of base scores."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.col(c)
    return total / F.lit(float(len(cols)))


@dataclass
class StackedClassifier:
    """Base learners, out-of-fold scores, and a meta learner on those scores."""

    bases: Mapping[str, Estimator]
    meta: Estimator
    key: str = "row_id"
    folds: int = 3
    seed: int = 42
    #: A column of row weights that every learner takes into account.
    weight: str | None = None
    #: Fits that run at the same time; each is a series of small jobs.
    at_once: int = 4

    def _fitted(self, tables: Sequence[tuple[str, DataFrame]]) -> list[Model]:
        """The base of each name fitted on its table, several at a time."""
        with ThreadPool(max(1, min(self.at_once, len(tables)))) as pool:
            run = inheritable_thread_target(tables[0][1].sparkSession)(lambda one: self._weighted(self.bases[one[0]]).fit(one[1])) if tables else None
            return pool.map(run, tables) if tables else []

    def _weighted(self, learner: Estimator) -> Estimator:
        return learner.copy().setWeightCol(self.weight) if self.weight else learner

    def _kept(self) -> list[str]:
        return [self.key, "label", *([self.weight] if self.weight else [])]

    def out_of_fold(self, df: DataFrame) -> DataFrame:
        """``key, label, fold`` and one score per base, each row scored by models that never saw it.

        A fold whose other rows hold one class only has nothing to learn from; its scores are
        that class.
        """
        folded = materialize(with_fold(df, self.folds, self.key, self.seed), "folded")
        sizes = {(r["fold"], r["label"]): r["n"] for r in
                 folded.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
        known = {k: {label for fold, label in sizes if fold != k} for k in range(self.folds)}
        todo = [(k, name) for k in range(self.folds) if len(known[k]) > 1 for name in self.bases]
        models = dict(zip(todo, self._fitted([(name, folded.where(F.col("fold") != k)) for k, name in todo])))
        parts = []
        for k in range(self.folds):
            held = folded.where(F.col("fold") == k)
            for name in self.bases:
                held = (score(models[k, name], held, name) if (k, name) in models
                        else held.withColumn(name, F.lit(float(min(known[k], default=0.0)))))
            parts.append(held.select(*self._kept(), "fold", *self.bases))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def fold_scores(self, oof: DataFrame) -> DataFrame:
        """``key, label, fold, score``: in each fold a meta learner fitted on its own rows.

        Where a fold's rows hold one class only, the plain mean of the base scores.
        """
        rows = oof.groupBy("fold").agg(F.count_distinct("label").alias("n")).collect()
        names, keep, out = list(self.bases), [self.key, "label", "fold"], None
        for fold, classes in sorted((r["fold"], r["n"]) for r in rows):
            part = oof.where(F.col("fold") == fold)
            if classes < 2:
                part = part.select(*keep, mean_score(names).alias("score"))
            else:
                vectors = to_vectors(part, names, keep)
                part = score(self.meta.fit(vectors), vectors, "score").drop(FEATURES)
            out = part if out is None else out.unionByName(part)
        return out

    def fit(self, df: DataFrame, oof: DataFrame | None = None) -> StackedModel:
        """``df`` holds the key, a 0/1 ``label`` and ``features``.

        ``oof`` may hand in the written :meth:`out_of_fold` table of the same rows.
        """
        table = materialize(df.select(*self._kept(), FEATURES).withColumn("label", F.col("label").cast("double")), "train")
        if table.select("label").distinct().limit(2).count() < 2:
            raise ValueError("training rows hold a single class")
        if oof is None:
            oof = materialize(self.out_of_fold(table), "out-of-fold")
        meta = self._weighted(self.meta).fit(to_vectors(oof, list(self.bases), self._kept()))
        fitted = dict(zip(self.bases, self._fitted([(name, table) for name in self.bases])))
        return StackedModel(fitted, meta, list(self.bases), oof)


@dataclass
class StackedModel:
    bases: Mapping[str, Model]
    meta: Model | None
    names: list[str]
    oof: DataFrame | None = field(default=None, repr=False)

    def base_scores(self, df: DataFrame) -> DataFrame:
        for name in self.names:
            df = score(self.bases[name], df, name)
        return df

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """All columns but the vector, the base scores, and the stacked score."""
        scored = self.base_scores(df)
        keep = [c for c in scored.columns if c != FEATURES]
        if self.meta is None:
            return scored.select(*keep, mean_score(self.names).alias(out))
        return score(self.meta, to_vectors(scored, self.names, keep), out).drop(FEATURES)

    def save(self, path: str) -> None:
        """Every learner in a folder of its own, and their names."""
        for name, model in self.bases.items():
            model.write().save(f"{path}/{name}")
        if self.meta is not None:
            self.meta.write().save(f"{path}/{_META}")
        rows = [(i, name, self.meta is not None) for i, name in enumerate(self.names)]
        small_table(SparkSession.active(), rows, "place int, name string, meta boolean").write.parquet(f"{path}/{_NAMES}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> StackedModel:
        """A saved stack; without the out-of-fold table, which is not saved."""
        rows = sorted(tuple(r) for r in spark.read.parquet(f"{path}/{_NAMES}").collect())
        bases = {name: DefaultParamsReader.loadParamsInstance(f"{path}/{name}", spark) for _, name, _ in rows}
        meta = DefaultParamsReader.loadParamsInstance(f"{path}/{_META}", spark) if rows[0][2] else None
        return StackedModel(bases, meta, [name for _, name, _ in rows])


# --- reweighted refits ---------------------------------------------------------------

@dataclass
class ReweightedFit:
    model: Model
    weights: dict
    history: list[dict]
    best_round: int


def reweighted_fit(make: Callable[[], Estimator], train: DataFrame, valid: DataFrame, rounds: int = 30,
                   patience: int = 5, method: str = "focal_adaptive", momentum: float = 0.9, frequency: int = 1,
                   legacy_schedule: bool = False, by_loss: bool = False) -> ReweightedFit:
    """Refit with class weights taken from the last round's validation scores.

    A net goes on from the round before; other learners start anew.  Keeps the model with the best macro F1 (or lowest focal loss) and stops after
    ``patience`` rounds without a better one.  Every round starts from the same two
    written tables; only the two weights change, so the plan does not grow, and a net's
    rows are packed once.
    """
    train, valid = materialize(train, "round-train"), materialize(valid, "round-valid")
    schedule = WeightSchedule(frequency, legacy_schedule)
    weights: dict = {}
    history: list[dict] = []
    best, best_model, best_round, waited, model, packed = None, None, -1, 0, None, None
    for r in range(rounds):
        learner = make().setWeightCol("weight")
        if isinstance(learner, FocalNet):
            packed = packed or packed_rows(train, learner.key)
            model = (learner if model is None else learner.started(model)).fit_packed(packed, weights)
        else:
            model = learner.fit(with_weight(train, "label", weights))
        scored = score(model, valid).select("label", "score")
        counts = scored.withColumn("pred", (F.col("score") > 0.5).cast("double"))
        macro = macro_metrics(counts, "label", "pred").first()["macro_f1"]
        loss = scored.agg(F.avg(focal_loss("label", "score")).alias("loss")).first()["loss"]
        if schedule.step():
            weights = momentum_update(weights, weight_map(class_weights(scored, "label", "score", method)), momentum)
        history.append({"round": r, "macro_f1": macro, "loss": loss,
                        "weight_0": weights.get(0.0), "weight_1": weights.get(1.0)})
        mark = -loss if by_loss else macro
        if best is None or mark > best:
            best, best_model, best_round, waited = mark, model, r, 0
        else:
            waited += 1
            if waited >= patience:
                break
    if packed is not None:
        packed.close()
    return ReweightedFit(best_model, weights, history, best_round)


# --- importances and rounds ------------------------------------------------------------

def importances(model: Model, names: Sequence[str]) -> list[tuple[str, float, float]]:
    """(feature, importance, importance scaled to 0..1)."""
    values = [float(v) for v in model.featureImportances.toArray()]
    low, high = min(values), max(values)
    return [(n, v, (v - low) / (high - low + 1e-6)) for n, v in zip(names, values)]


def importance_table(df: DataFrame, model: Model, names: Sequence[str]) -> DataFrame:
    return small_table(
        df.sparkSession,
        importances(model, names), "feature string, importance double, weight double")


def top_importances(table: DataFrame, n: int = 10) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(n)


def round_metrics(model: PenalisedBoostModel, df: DataFrame, label: str = "label") -> DataFrame:
    """Loss, accuracy and F1 after each boosting round, in one pass over the rows.

    Each task walks all trees at once and passes on one row per round.
    """
    rounds = len(model.ensemble.feature)
    names = ["round", "n", "loss", "hits", "tp", "miss"]

    def add_up(batches):
        sums = np.zeros((rounds, 5))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)[:, None]
            margin = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, rounds)
            pred = margin > 0
            right = pred == (y == 1)
            parts = [np.ones_like(margin), np.logaddexp(0, -(2 * y - 1) * margin), right, pred & (y == 1), ~right]
            sums += np.column_stack([p.sum(0) for p in parts])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(rounds), pa.int32()), *[pa.array(c, pa.float64()) for c in sums.T]], names=names)

    parts = model.staged(df, [label]).mapInArrow(add_up, "round int, " + ", ".join(f"{c} double" for c in names[1:]))
    total = parts.groupBy("round").agg(*[F.sum(c).alias(c) for c in names[1:]])
    return total.select(
        "round", F.try_divide("loss", "n").alias("loss"), F.try_divide("hits", "n").alias("accuracy"),
        F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), F.lit(2.0) * F.col("tp") + F.col("miss")), F.lit(0.0)).alias("f1"),
    ).orderBy("round")


# --- configuration comparisons -----------------------------------------------------------

# The five compared configurations.
REGULARIZATION = (
    ("none", dict(depth=10, rows=1.0, cols=1.0, l1=0.0, l2=0.0)),
    ("l1 only", dict(depth=10, rows=1.0, cols=1.0, l1=0.5, l2=0.0)),
    ("l2 only", dict(depth=10, rows=1.0, cols=1.0, l1=0.0, l2=1.0)),
    ("l1 and l2", dict(depth=6, rows=0.8, cols=0.8, l1=0.1, l2=1.0)),
    ("strong", dict(depth=4, rows=0.7, cols=0.7, l1=1.0, l2=2.0)),
)


def regularization_compare(train: DataFrame, test: DataFrame, trees: int = 100,
                           configs=REGULARIZATION) -> DataFrame:
    """Train and test measures per configuration, and the features its trees use.

    All configurations grow side by side on one binned table.
    """
    rows = []
    models = fit_settings(train, [BoostSettings(trees=trees, **c) for _, c in configs])
    for (name, c), model in zip(configs, models):
        used = sum(1 for v in model.featureImportances.toArray() if v > 0.001)
        for part, table in (("train", train), ("test", test)):
            m = evaluate(score(model, table), "label", "score").first()
            rows.append((name, part, c["l1"], c["l2"], c["depth"], m["accuracy"], m["precision"], m["recall"], m["f1"],
                         m["auc"], used))
    return small_table(
        train.sparkSession,
        rows, "config string, part string, l1 double, l2 double, depth int, accuracy double, precision double, "
              "recall double, f1 double, auc double, used_features int")
