import pytest
from pyspark.sql import functions as F

from netweave.checks.base import NUMERIC, TEXT, labelled
from netweave.operators import models as mod
from netweave.operators.metrics import evaluate
from netweave.plans.presets import TRAINING
from netweave.plans.training import TrainedFlows, train


def small_bases(width):
    return {"p_a": mod.logistic(penalty=1e-3, iterations=10), "p_b": mod.forest(4, 4)}


METAS = {"boosted": lambda **s: mod.penalised_trees(trees=10, depth=3), "searched": mod.penalised_trees,
         "forest": lambda: mod.forest(4, 3)}


@pytest.mark.parametrize("variant", sorted(TRAINING))
def test_variant_trains_saves_and_loads(spark, sf, tmp_path, variant):
    df = labelled(spark, sf)
    got = train(df, variant, NUMERIC, TEXT, domain="flag" if "domain" in variant else None, folds=2, bases=small_bases,
                metas=METAS, trials=2)
    scored = got.score(df, ["label"]).cache()
    out = "calibrated" if "domain" in variant else "score"
    assert scored.count() == df.count() and evaluate(scored, "label", out).first()["auc"] > 0.8
    assert bool(got.history) == ("early_stop" in TRAINING[variant])
    got.save(str(tmp_path / "model"))
    back = TrainedFlows.load(spark, str(tmp_path / "model"))
    again = back.score(df).select("row_id", F.col(out).alias("again"))
    both = scored.join(again, "row_id")
    assert back.variant == variant and both.count() == df.count()
    assert both.where(f"abs({out} - again) > 1e-9").count() == 0
    scored.unpersist()


def test_mixed_rows_keep_both_labels(spark, sf, monkeypatch):
    """Every mixed row reaches the learners twice, with weights that add up to one."""
    from netweave.plans import training

    seen = {}

    class Stop(Exception):
        pass

    def stop(self, df):
        seen["rows"], seen["weight"] = df, self.weight
        raise Stop

    monkeypatch.setattr(training.StackedClassifier, "out_of_fold", stop)
    with pytest.raises(Stop):
        train(labelled(spark, sf), "full_mixup", NUMERIC, TEXT, bases=small_bases, metas=METAS)
    rows, w = seen["rows"], seen["weight"]
    assert w is not None and rows.count() == 6000
    soft = rows.where(f"{w} < 1 and {w} > 0")
    total = rows.agg(F.sum(w)).first()[0]
    assert total == pytest.approx(4000, rel=1e-6) and soft.where(f"{w} < 0.5").count() > 0
    assert soft.select("label").distinct().count() == 2


def test_domain_variant_needs_a_domain(spark, sf):
    with pytest.raises(ValueError, match="domain"):
        train(labelled(spark, sf), "subset_domain")
