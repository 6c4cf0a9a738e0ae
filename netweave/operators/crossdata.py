"""Training and evaluation flows across datasets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.functions.labels import binary_label, detect_label_rule
from netweave.operators.features import FlowPreprocessorModel
from netweave.operators.metrics import evaluate
from netweave.operators.models import StackedClassifier, StackedModel, penalised_trees, to_vectors
from netweave.operators.resample import smote
from netweave.operators.sampling import split_stratified, with_fold
from netweave.operators.search import Range, model_search
from netweave.operators.tables import with_passthrough
from netweave.plans.mapping import MappingSpec, conform
from netweave.session import materialize


@dataclass
class CrossOptions:
    """``resample_below`` balances the evaluated rows first; off unless asked for.
    ``refit_bounds`` takes clip limits from the evaluated table instead of the fitted ones."""

    label: str = "labels"
    key: str = "row_id"
    spec: MappingSpec | None = None
    resample_below: float | None = None
    refit_bounds: bool = False
    threshold: float = 0.5


def prepare(df: DataFrame, prep: FlowPreprocessorModel, options: CrossOptions) -> DataFrame:
    """Conform another dataset, find its label rule, and apply the fitted chain."""
    if options.spec is not None:
        keyed = df.withColumn("_key", F.col(options.key))
        df = conform(keyed, with_passthrough(options.spec, {options.key: "_key"}))
    if options.label not in df.columns:
        raise ValueError(f"no label column {options.label!r}")
    rule = detect_label_rule(df, options.label, options.key)
    labelled = df.withColumn("label", binary_label(F.col(options.label), rule).cast("double"))
    if options.refit_bounds:
        prep = prep.refit_bounds(labelled)
    return prep.transform(labelled, keep=[options.key, "label"])


def cross_evaluate(df: DataFrame, prep: FlowPreprocessorModel, model: StackedModel, options: CrossOptions) -> DataFrame:
    """All measures of a stacked model on another dataset, one row."""
    table = prepare(df, prep, options)
    names = [c for c in table.columns if c not in (options.key, "label")]
    if options.resample_below is not None:
        table = materialize(table, "evaluated")
        table = smote(table, names, "label", options.key, when_below=options.resample_below)
    scored = model.score(to_vectors(table, names, [options.key, "label"]))
    return evaluate(scored, "label", "score", options.threshold)


@dataclass
class FineTuned:
    model: StackedModel
    metrics: DataFrame
    trials: DataFrame


def cross_finetune(df: DataFrame, prep: FlowPreprocessorModel, bases: Mapping[str, Estimator], options: CrossOptions,
                   space: Mapping[str, Range], trials: int = 10, folds: int = 3, seed: int = 42,
                   resample: bool = False) -> FineTuned:
    """Refit the stack on another dataset with a meta learner found by a model-based search, tested on held-out rows."""
    table = prepare(df, prep, options)
    names = [c for c in table.columns if c not in (options.key, "label")]
    parts = materialize(split_stratified(table, "label", 0.2, options.key, seed), "finetune")
    train, test = parts.where(F.col("split") == "train"), parts.where(F.col("split") == "test")
    if resample:
        train = materialize(smote(train, names, "label", options.key, seed=seed), "resampled")
    vectors = materialize(to_vectors(train, names, [options.key, "label"]), "vectors")
    stack = StackedClassifier(bases, penalised_trees(key=options.key), options.key, folds, seed)
    oof = materialize(stack.out_of_fold(vectors), "meta")
    meta_rows = to_vectors(with_fold(oof.drop("fold"), folds, options.key, seed + 1), list(bases), [options.key, "label", "fold"])
    results, best = model_search(materialize(meta_rows, "meta-vectors"), space, trials, folds=folds, key=options.key, seed=seed)
    stack.meta = penalised_trees(key=options.key, **best)
    model = stack.fit(vectors, oof)
    scored = model.score(to_vectors(test, names, [options.key, "label"]))
    return FineTuned(model, evaluate(scored, "label", "score", options.threshold), results)
