"""From a labelled table to a fitted, stored model: the training variants as one call.

``train`` runs the chain of a variant in :data:`netweave.plans.presets.TRAINING`: preprocess,
add noisy twins, balance, score base learners out of fold, fit the meta learner on those
scores, and calibrate per domain where the variant says so.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.functions.hashing import row_hash
from netweave.operators.augment import augment, mask, mask_probability, mixup
from netweave.operators.calibrate import calibrate, fit_calibrator
from netweave.operators.features import FlowPreprocessorModel
from netweave.operators.models import (
    StackedClassifier,
    StackedModel,
    default_bases,
    forest,
    logistic,
    penalised_trees,
    reweighted_fit,
    to_vectors,
)
from netweave.operators.resample import smote
from netweave.operators.sampling import sample_fraction, with_fold
from netweave.operators.search import MODEL_SPACE, model_search
from netweave.plans.presets import TRAINING, full, subset_robust, wide
from netweave.session import materialize, small_table

METAS: dict[str, Callable[..., Estimator]] = {"boosted": penalised_trees, "logistic": logistic, "forest": forest,
                                              "searched": penalised_trees}
#: Rounds over which the masking schedules run.
_ROUNDS = 50
#: The domain under a name of its own, since it may be a feature too.
_DOMAIN = "_of_domain"
_WEIGHT = "_row_weight"


@dataclass
class TrainedFlows:
    """A fitted chain and stack, with per-domain sigmoids for variants that have them."""

    variant: str
    prep: FlowPreprocessorModel
    stack: StackedModel
    key: str = "row_id"
    domain: str | None = None
    calibration: DataFrame | None = None
    history: list[dict] = field(default_factory=list)

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``key``, the columns in ``keep``, the base scores and ``score``; ``calibrated`` if there is a calibration."""
        if self.calibration is None:
            return self.stack.score(self.prep.vector(df, [self.key, *keep]))
        named = df.withColumn(_DOMAIN, F.col(self.domain))
        scored = self.stack.score(self.prep.vector(named, [self.key, *keep, _DOMAIN]))
        return calibrate(scored, self.calibration, "score", _DOMAIN).drop(_DOMAIN)

    def save(self, path: str) -> None:
        """Everything under one folder, which must not exist."""
        spark = SparkSession.active()
        note = json.dumps({"variant": self.variant, "key": self.key, "domain": self.domain,
                           "calibrated": self.calibration is not None})
        small_table(spark, [(note,)], "note string").write.parquet(f"{path}/note")
        self.prep.save(spark, f"{path}/prep")
        self.stack.save(f"{path}/stack")
        if self.calibration is not None:
            self.calibration.write.parquet(f"{path}/calibration")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TrainedFlows:
        note = json.loads(spark.read.parquet(f"{path}/note").first()["note"])
        table = spark.read.parquet(f"{path}/calibration") if note["calibrated"] else None
        return TrainedFlows(note["variant"], FlowPreprocessorModel.load(spark, f"{path}/prep"),
                            StackedModel.load(spark, f"{path}/stack"), note["key"], note["domain"], table)


def train(df: DataFrame, variant: str, numeric: Sequence[str] = (), text: Sequence[str] = (), key: str = "row_id",
          label: str = "label", domain: str | None = None, folds: int = 3, seed: int = 42,
          bases: Callable[[int], Mapping[str, Estimator]] = default_bases,
          metas: Mapping[str, Callable[..., Estimator]] | None = None, trials: int | None = None) -> TrainedFlows:
    """Fit one variant on rows with a unique ``key`` and a 0/1 ``label``.

    The full variants take the given numeric and text columns, the subset ones the six
    columns of :data:`netweave.plans.schemas.MODEL_SUBSET`.  ``domain`` names the column that
    domain variants carry along and calibrate by.  Learners have no epochs here: a masking
    schedule gives each twin the probability of a round drawn from its key.  A mixed row has
    both labels, each with its share as the row's weight, which all learners take.
    """
    options = TRAINING[variant]
    if options.get("calibrate") and domain is None:
        raise ValueError(f"{variant} needs a domain column")
    make = {**METAS, **(metas or {})}[options["meta"]]
    if "fraction" in options:
        df = sample_fraction(df, options["fraction"], key, seed)
    df = df.withColumn(label, F.col(label).cast("double"))
    chain = subset_robust() if variant.startswith("subset") else (wide if variant == "wide" else full)(numeric, text, label)
    prep = chain.fit(df)
    names = prep.feature_names()
    safe = [f"x{i}" for i in range(len(names))]
    carry = [_DOMAIN] if domain else []
    df = df.withColumn(_DOMAIN, F.col(domain)) if domain else df
    flat = prep.transform(df, [key, label, *carry])
    table = materialize(flat.toDF(key, "label", *carry, *safe), "features")

    rows = _twins(table, safe, key, options, seed)
    if "mixup" in options:
        mixed = mixup(rows.withColumn("_uid", _uid(key)), safe, "label", "_uid", options["mixup"], seed)
        rows = rows.withColumn(_WEIGHT, F.lit(1.0)).unionByName(mixed.select(
            F.regexp_extract("_uid", "^(.*)-", 1).cast(dict(rows.dtypes)[key]).alias(key), "label",
            (F.col("draw") + 2).alias("copy"), F.col("weight").alias(_WEIGHT), *safe), allowMissingColumns=True)
        carry = [*carry, _WEIGHT]
    rows = _balanced(materialize(rows, "twins"), safe, prep, key, options["resample"], carry, seed)

    learners = bases(len(names))
    weight = _WEIGHT if _WEIGHT in carry else None
    stack = StackedClassifier(learners, make(), key, folds, seed, weight)
    vectors = materialize(to_vectors(rows, safe, [key, "label", *carry]), "train")
    oof = materialize(stack.out_of_fold(vectors), "out-of-fold")
    scores = oof
    if options["resample"] == "scores":
        scores = materialize(smote(oof.withColumn("_uid", F.monotonically_increasing_id()), list(learners), "label", "_uid",
                                   carry=[weight] if weight else [], seed=seed).withColumnRenamed("_uid", key), "balanced-scores")
    history: list[dict] = []
    if options["meta"] == "searched":
        dealt = with_fold(scores.drop("fold"), folds, key, seed + 1)
        meta_rows = materialize(to_vectors(dealt, list(learners), [key, "label", "fold"]), "meta-vectors")
        _, best = model_search(meta_rows, MODEL_SPACE, trials or options["trials"], folds=folds, key=key, seed=seed)
        stack.meta = make(**best)
    model = stack.fit(vectors, scores)
    if "early_stop" in options:
        both = materialize(to_vectors(scores, list(learners), [key, "label"]), "meta-vectors")
        held = F.pmod(row_hash(key, seed=seed), F.lit(5)) == 0
        tuned = reweighted_fit(make, both.where(~held), both.where(held), rounds=trials or 30, patience=5)
        model.meta, history = tuned.model, tuned.history
    fits = None
    if options.get("calibrate"):
        scored = model.score(to_vectors(table, safe, [key, "label", _DOMAIN]))
        fits = materialize(fit_calibrator(scored, "score", "label", _DOMAIN), "calibration")
    return TrainedFlows(variant, prep, model, key, domain, fits, history)


def _uid(key: str):
    return F.concat_ws("-", F.col(key).cast("string"), F.col("copy").cast("string"))


def _twins(table: DataFrame, names: Sequence[str], key: str, options: Mapping, seed: int) -> DataFrame:
    """The rows and a noisy, masked twin of each; only the rows where a variant has neither."""
    if not (options["noise"] or options["mask"] or "schedule" in options):
        return table.withColumn("copy", F.lit(0))
    both = augment(table, names, key, options["noise"], options["mask"], seed)
    if "schedule" not in options:
        return both
    epoch = F.pmod(row_hash(key, seed=f"epoch:{seed}"), F.lit(_ROUNDS))
    hidden = mask(both.where("copy = 1"), names, key, mask_probability(epoch, options["schedule"]), seed=seed)
    return both.where("copy = 0").unionByName(hidden)


def _balanced(rows: DataFrame, names: Sequence[str], prep: FlowPreprocessorModel, key: str, how: str,
              carry: Sequence[str], seed: int) -> DataFrame:
    """Raise the smaller class to the size of the larger one, where the variant balances features."""
    if how == "scores":
        return rows
    codes = [n for n, f in zip(names, prep.feature_names()) if f in prep.options.text] if how == "categorical" else []
    plain = [n for n in names if n not in codes]
    unique = rows.withColumn("_uid", _uid(key))
    grown = smote(unique, plain, "label", "_uid", categorical=codes, carry=[key, *carry], seed=seed)
    # Synthetic rows carry their seed's key, so that folds keep them together.
    return materialize(grown.select(key, "label", *carry, *names), "balanced")
