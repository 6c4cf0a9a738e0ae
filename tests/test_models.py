import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from netweave.checks.base import NUMERIC, TEXT, labelled
from netweave.checks.models import foreign
from netweave.operators import models as mod
from netweave.operators import search as srch
from netweave.operators.crossdata import CrossOptions, cross_evaluate, cross_finetune, prepare
from netweave.operators.features import FlowPreprocessor
from netweave.operators.metrics import evaluate, roc_auc
from netweave.operators.sampling import with_fold
from netweave.session import materialize


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        y = int(i % 4 == 0)
        x = rng.normal(size=3) + 2.5 * y
        rows.append((i, float(y), Vectors.dense(x.tolist())))
    return materialize(spark.createDataFrame(rows, ["row_id", "label", "features"]), "separable")


LEARNERS = {
    "net": lambda: mod.dense_net(3, hidden=(8,), iterations=30),
    "logistic": lambda: mod.logistic(penalty=0.01),
    "forest": lambda: mod.forest(10, 5),
    "boosted": lambda: mod.boosted_trees(5, 3),
    "penalised": lambda: mod.penalised_trees(trees=10, depth=3),
}


@pytest.mark.parametrize("name", sorted(LEARNERS))
def test_learners_separate(separable, name):
    scored = mod.score(LEARNERS[name]().fit(separable), separable)
    assert roc_auc(scored, "label", "score").first()[0] > 0.9
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1


def test_stack_scores_rows_out_of_fold(separable, tmp_path):
    stack = mod.StackedClassifier({"p_a": LEARNERS["logistic"](), "p_b": LEARNERS["forest"]()}, mod.logistic(), folds=3)
    model = stack.fit(separable)
    assert model.oof.count() == 600 and model.oof.select("fold").distinct().count() == 3
    assert model.oof.groupBy("row_id").count().where("count > 1").count() == 0
    scored = model.score(separable)
    assert set(scored.columns) == {"row_id", "label", "p_a", "p_b", "score"}
    assert evaluate(scored, "label", "score").first()["auc"] > 0.9
    model.save(str(tmp_path / "stack"))
    back = mod.StackedModel.load(separable.sparkSession, str(tmp_path / "stack")).score(separable)
    both = scored.join(back.withColumnRenamed("score", "again").select("row_id", "again"), "row_id")
    assert both.count() == 600 and both.where("abs(score - again) > 1e-9").count() == 0
    model.meta = None
    model.save(str(tmp_path / "mean"))
    back = mod.StackedModel.load(separable.sparkSession, str(tmp_path / "mean"))
    assert back.meta is None and back.names == ["p_a", "p_b"]
    assert model.score(separable).where("abs(score - (p_a + p_b) / 2) > 1e-12").count() == 0


def test_folds_with_one_class(spark, separable):
    """A fold without both classes is averaged; a fold whose other rows lack one takes that class."""
    stack = mod.StackedClassifier({"p_a": LEARNERS["logistic"](), "p_b": LEARNERS["logistic"]()}, mod.logistic(), folds=2)
    oof = stack.out_of_fold(separable)
    one = oof.where("fold = 0 OR label = 1")
    got = stack.fold_scores(one)
    assert got.columns == ["row_id", "label", "fold", "score"] and got.count() == one.count()
    mean = got.where("fold = 1").join(oof.select("row_id", "p_a", "p_b"), "row_id")
    assert mean.where("abs(score - (p_a + p_b) / 2) > 1e-12").count() == 0
    lone = with_fold(separable, 2, "row_id", stack.seed).where("fold = 0 OR label = 1").drop("fold")
    assert {r[0] for r in stack.out_of_fold(lone).where("fold = 0").select("p_a").distinct().collect()} == {1.0}


def test_single_class_cannot_be_stacked(separable):
    with pytest.raises(ValueError, match="single class"):
        mod.StackedClassifier({"p_a": LEARNERS["logistic"]()}, mod.logistic()).fit(separable.where("label = 0"))


def test_reweighting_stops_on_patience(separable):
    fit = mod.reweighted_fit(lambda: mod.logistic(penalty=0.01, iterations=10), separable, separable, rounds=10, patience=2)
    assert len(fit.history) <= 10 and fit.history[fit.best_round]["macro_f1"] == max(h["macro_f1"] for h in fit.history)
    assert set(fit.weights) == {0.0, 1.0}
    by_loss = mod.reweighted_fit(lambda: mod.logistic(penalty=0.01, iterations=10), separable, separable, rounds=3, by_loss=True)
    assert by_loss.history[by_loss.best_round]["loss"] == min(h["loss"] for h in by_loss.history)


def test_importances_and_rounds(separable):
    model = mod.penalised_trees(trees=4, depth=3, rate=0.3).fit(separable)
    table = mod.importance_table(separable, model, ["a", "b", "c"])
    low, high = table.agg(F.min("weight"), F.max("weight")).first()
    assert low == 0.0 and 0.99 < high <= 1.0
    assert [r["feature"] for r in mod.top_importances(table, 2).collect()] == [
        r["feature"] for r in table.orderBy(F.desc("importance")).limit(2).collect()]
    rounds = {r["round"]: r for r in mod.round_metrics(model, separable).collect()}
    y = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    loss = model.staged(separable, ["label"]).select(*[F.avg(F.log1p(F.exp(-y * F.col("margins")[i]))) for i in range(4)]).first()
    assert [rounds[i]["loss"] for i in range(4)] == pytest.approx(list(loss), rel=1e-9)
    final = evaluate(mod.score(model, separable), "label", "score").first()
    assert rounds[3]["f1"] == pytest.approx(final["f1"])


@pytest.fixture(scope="module")
def fitted(spark, sf):
    df = labelled(spark, sf).withColumn("label", F.col("label").cast("double"))
    prep = FlowPreprocessor(numeric=NUMERIC, text=TEXT, label="label").fit(df)
    table = materialize(prep.vector(df, ["row_id", "label"]), "fitted")
    stack = mod.StackedClassifier({"p_a": mod.logistic(penalty=1e-3, iterations=10), "p_b": mod.forest(5, 4)}, mod.logistic(), folds=2)
    return prep, stack.fit(table)


def test_cross_evaluation(spark, sf, fitted):
    prep, model = fitted
    other = foreign(spark, sf)
    plain = cross_evaluate(other, prep, model, CrossOptions()).first()
    assert plain["auc"] > 0.8 and plain["tp"] + plain["fn"] + plain["fp"] + plain["tn"] == 1000
    options = CrossOptions(resample_below=0.45, refit_bounds=True)
    balanced = cross_evaluate(other, prep, model, options).first()
    assert balanced["tp"] + balanced["fn"] == balanced["fp"] + balanced["tn"]
    with pytest.raises(ValueError, match="no label column"):
        prepare(other, prep, CrossOptions(label="absent"))


def test_cross_finetuning(spark, sf, fitted):
    prep, _ = fitted
    bases = {"p_a": mod.logistic(penalty=1e-3, iterations=10), "p_b": mod.forest(4, 3)}
    space = {"trees": srch.Range(2, 4, whole=True), "depth": srch.Range(2, 3, whole=True)}
    tuned = cross_finetune(foreign(spark, sf), prep, bases, CrossOptions(), space, trials=2, folds=2)
    assert tuned.metrics.first()["auc"] > 0.8 and tuned.trials.count() == 2


class Stop(Exception):
    pass


def test_model_queries_use_full_defaults(spark, monkeypatch):
    """No query hands its operator fewer trees, rounds, bases, trials or settings than the defaults."""
    from unittest.mock import MagicMock

    from netweave.checks import models as queries

    seen = {}

    def stop(name):
        def record(*args, **named):
            seen[name] = args, named
            raise Stop

        return record

    prep = MagicMock()
    prep.feature_names.return_value = ["a", "b"]
    for name in ("labelled", "foreign", "with_fold", "cross_evaluate", "FlowPreprocessor"):
        monkeypatch.setattr(queries, name, MagicMock())
    queries.FlowPreprocessor.return_value.fit.return_value = prep
    monkeypatch.setattr(queries, "prepared", lambda *_: (MagicMock(), prep))
    monkeypatch.setattr(queries, "parts", lambda _: (MagicMock(), MagicMock()))
    monkeypatch.setattr(queries.mod, "default_bases", lambda width: ("all", width))
    for owner, name in ((queries.mod, "StackedClassifier"), (queries.mod, "penalised_trees"), (queries, "search"),
                        (queries, "model_search"),
                        (queries, "cross_finetune"), (queries.mod, "regularization_compare")):
        monkeypatch.setattr(owner, name, stop(name))

    def call(fn, name):
        with pytest.raises(Stop):
            fn(None, None)
        return seen.pop(name)

    for fn in (queries.stack_fit, queries.model_facts, queries.cross_eval):
        args, named = call(fn, "StackedClassifier")
        assert args[0] == ("all", 2) and "folds" not in named
    for fn in (queries.importance_rank, queries.round_metrics):
        assert call(fn, "penalised_trees") == ((), {})
    assert call(queries.regularization_compare, "regularization_compare")[1] == {}
    monkeypatch.setattr(queries, "materialize", lambda df, name: df)
    assert call(queries.search_random, "search")[0][1] == srch.draw_settings(srch.RANDOM_SPACE, 20)
    assert call(queries.search_grid, "search")[0][1] == srch.grid_settings(srch.GRID_SPACE)
    assert call(queries.search_model, "model_search")[0][1:] == (srch.MODEL_SPACE, 30)
    assert call(queries.search_penalised, "model_search")[0][1:] == (srch.PENALISED_SPACE, 50)
    args, named = call(queries.finetune, "cross_finetune")
    assert args[2] == ("all", 2) and args[4] == srch.SHORT_SPACE and not named
