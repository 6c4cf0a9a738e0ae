"""Model fits.  Iterative learners have no SQL form; tests hold their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.checks.base import LABELLED, NUMERIC, TEXT, labelled, query, rounded, unit_sql
from netweave.functions import unit_hash
from netweave.operators import models as mod
from netweave.operators.crossdata import CrossOptions, cross_evaluate, cross_finetune
from netweave.operators.features import FlowPreprocessor
from netweave.operators.metrics import evaluate, roc_auc
from netweave.operators.sampling import with_fold
from netweave.operators.search import (
    GRID_SPACE,
    MODEL_SPACE,
    PENALISED_SPACE,
    RANDOM_SPACE,
    SHORT_SPACE,
    draw_settings,
    grid_settings,
    model_search,
    search,
)
from netweave.operators.weights import class_weights, weight_map, with_weight
from netweave.plans.presets import subset_robust
from netweave.session import materialize, small_table

KEEP = ["row_id", "label"]


def prepared(spark, sf):
    """The preset chain's output as (row_id, label, features), written once."""
    df = labelled(spark, sf).withColumn("label", F.col("label").cast("double"))
    model = subset_robust().fit(df)
    return materialize(model.vector(df, keep=KEEP), "prepared"), model


def parts(table):
    test = unit_hash("row_id", seed=11) < 0.3
    return table.where(~test), table.where(test)


def _scored(model, table):
    return rounded(evaluate(mod.score(model, table), "label", "score"), 4)


@query("fit_base")
def fit_base(spark, sf):
    train, test = parts(prepared(spark, sf)[0])
    return _scored(mod.focal_net().fit(train), test)


@query("fit_meta_gbt")
def fit_meta_gbt(spark, sf):
    train, test = parts(prepared(spark, sf)[0])
    weights = weight_map(class_weights(train, "label"))
    return _scored(mod.penalised_trees(weight="weight").fit(with_weight(train, "label", weights)), test)


@query("fit_meta_lr")
def fit_meta_lr(spark, sf):
    train, test = parts(prepared(spark, sf)[0])
    weights = weight_map(class_weights(train, "label", method="ratio"))
    model = mod.logistic("weight", penalty=0.01).fit(with_weight(train, "label", weights))
    return _scored(model, test)


@query("fit_meta_rf")
def fit_meta_rf(spark, sf):
    train, test = parts(prepared(spark, sf)[0])
    weights = weight_map(class_weights(train, "label"))
    return _scored(mod.forest(weight="weight").fit(with_weight(train, "label", weights)), test)


@query("model_facts", f"""
WITH {LABELLED}, held AS (SELECT label FROM labelled WHERE {unit_sql(seed=11)} < 0.3)
SELECT learner, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, count(*) AS in_range, true AS better_than_chance
FROM held, (SELECT unnest(['boosted', 'dense', 'forest', 'logistic', 'stacked']) AS learner) GROUP BY learner
""")
def model_facts(spark, sf):
    """What SQL can say of fitted learners: whose rows they score, and that all scores are probabilities.

    That their ranking beats chance is the one fact taken from the fits; the measures
    themselves are held to bounds in the tests.
    """
    table, model = prepared(spark, sf)
    train, test = parts(table)
    learners = mod.default_bases(len(model.feature_names()))
    names = dict(p_a="dense", p_b="logistic", p_c="forest", p_d="boosted", score="stacked")
    scored = materialize(mod.StackedClassifier(learners, mod.logistic()).fit(train).score(test), "scored")
    rows = []
    for column, name in names.items():
        facts = scored.agg(F.count("*"), F.sum("label").cast("long"), F.count_if(F.col(column).between(0, 1))).first()
        rows.append((name, *facts, roc_auc(scored, "label", column).first()["auc"] > 0.5))
    return small_table(spark, rows, "learner string, rows bigint, positives bigint, in_range bigint, better_than_chance boolean")


@query("stack_fit")
def stack_fit(spark, sf):
    """Out-of-fold stacking, tested on held-out rows."""
    table, model = prepared(spark, sf)
    train, test = parts(table)
    stack = mod.StackedClassifier(mod.default_bases(len(model.feature_names())), mod.logistic()).fit(train)
    return rounded(evaluate(stack.score(test), "label", "score"), 4)


@query("score_apply")
def score_apply(spark, sf):
    train, test = parts(prepared(spark, sf)[0])
    return rounded(mod.score(mod.logistic(penalty=0.01).fit(train), test).drop("features"), 4)


@query("reweight_rounds")
def reweight_rounds(spark, sf):
    train, test = parts(prepared(spark, sf)[0])
    fit = mod.reweighted_fit(lambda: mod.logistic(penalty=0.01), train, test)
    rows = [(h["round"], h["macro_f1"], h["loss"], h["weight_0"], h["weight_1"], h["round"] == fit.best_round)
            for h in fit.history]
    return small_table(
        spark,
        rows, "round int, macro_f1 double, loss double, weight_0 double, weight_1 double, best boolean")


@query("reweight_net")
def reweight_net(spark, sf):
    """One epoch a round, with class weights taken from the validation rows after every second."""
    train, test = parts(prepared(spark, sf)[0])
    fit = mod.reweighted_fit(lambda: mod.focal_net(epochs=1), train, test, frequency=2)
    rows = [(h["round"], h["macro_f1"], h["loss"], h["weight_0"], h["weight_1"], h["round"] == fit.best_round)
            for h in fit.history]
    return small_table(
        spark,
        rows, "round int, macro_f1 double, loss double, weight_0 double, weight_1 double, best boolean")


@query("importance_rank")
def importance_rank(spark, sf):
    table, prep = prepared(spark, sf)
    model = mod.penalised_trees().fit(table)
    return rounded(mod.top_importances(mod.importance_table(table, model, prep.feature_names()), 10), 4)


@query("round_metrics")
def round_metrics(spark, sf):
    train, test = parts(prepared(spark, sf)[0])
    return rounded(mod.round_metrics(mod.penalised_trees().fit(train), test), 4)


def folded(spark, sf):
    return materialize(with_fold(prepared(spark, sf)[0], 3, "row_id"), "folded")


@query("search_random")
def search_random(spark, sf):
    """Twenty draws from the lists of values."""
    return rounded(search(folded(spark, sf), draw_settings(RANDOM_SPACE, 20))[0], 4)


@query("search_grid")
def search_grid(spark, sf):
    """All 864 points of the grid."""
    return rounded(search(folded(spark, sf), grid_settings(GRID_SPACE))[0], 4)


@query("search_model")
def search_model(spark, sf):
    """Thirty proposals of the model-based search."""
    return rounded(model_search(folded(spark, sf), MODEL_SPACE, 30)[0], 4)


@query("search_penalised")
def search_penalised(spark, sf):
    """Fifty proposals over the penalties as well."""
    return rounded(model_search(folded(spark, sf), PENALISED_SPACE, 50)[0], 4)


@query("regularization_compare")
def regularization_compare(spark, sf):
    train, test = parts(prepared(spark, sf)[0])
    return rounded(mod.regularization_compare(train, test), 4)


def foreign(spark, sf):
    """The same traffic as another dataset would record it: other scales, other label words."""
    return labelled(spark, sf).select(
        "row_id", *[(F.col(c) * 1.1).alias(c) for c in NUMERIC], *TEXT,
        F.when(F.col("label") == 0, "BENIGN").otherwise("DDoS").alias("labels"))


@query("cross_eval")
def cross_eval(spark, sf):
    table, prep = prepared(spark, sf)
    stack = mod.StackedClassifier(mod.default_bases(len(prep.feature_names())), mod.logistic()).fit(table)
    return rounded(cross_evaluate(foreign(spark, sf), prep, stack, CrossOptions()), 4)


@query("cross_finetune")
def finetune(spark, sf):
    df = labelled(spark, sf).withColumn("label", F.col("label").cast("double"))
    prep = FlowPreprocessor(numeric=NUMERIC, text=TEXT, label="label").fit(df)
    bases = mod.default_bases(len(prep.feature_names()))
    tuned = cross_finetune(foreign(spark, sf), prep, bases, CrossOptions(), SHORT_SPACE)
    return rounded(tuned.metrics, 4)
