import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from netweave.operators import dense
from netweave.operators import models as mod
from netweave.operators.metrics import evaluate
from netweave.session import materialize


@pytest.fixture(scope="module")
def ring(spark):
    """Label 1 inside a circle, which no line tells apart; one row in four."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(900):
        x = rng.normal(size=3)
        rows.append((i, float(x[0] ** 2 + x[1] ** 2 < 0.6), 1.0 + i % 2, Vectors.dense(x.tolist())))
    return materialize(spark.createDataFrame(rows, ["row_id", "label", "weight", "features"]).repartition(6), "ring")


@pytest.mark.parametrize("settings", [dense.NetSettings(hidden=(5, 4)), dense.NetSettings(hidden=(6,), alpha=1.0, gamma=0.0),
                                      dense.NetSettings(hidden=(), gamma=1.5)])
@pytest.mark.parametrize("dropout", [False, True])
def test_gradient_is_the_slope_of_the_loss(settings, dropout):
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(20, 3)), (rng.random(20) < 0.4).astype(float), rng.random(20)
    key = rng.integers(0, 2 ** 63, 20).astype(np.uint64) if dropout else None
    parameters = [p + 0.1 * rng.normal(size=p.shape) for p in dense.initial(3, settings)]
    _, n, grads = dense.gradient(parameters, x, y, w, settings, key, 3)
    assert n == pytest.approx(w.sum())
    for p, g in zip(parameters, grads):
        for at in np.ndindex(p.shape):
            old, sides = p[at], []
            for step in (1e-6, -1e-6):
                p[at] = old + step
                sides.append(dense.gradient(parameters, x, y, w, settings, key, 3)[0])
            p[at] = old
            assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-6, rel=2e-4, abs=1e-7)


def test_loss_is_that_of_the_column(spark):
    z, y = np.array([-3.0, -0.2, 0.0, 2.0, 900.0, -900.0, 900.0]), np.array([1.0, 0, 1, 1, 1, 1, 0])
    loss, slope = dense.focal(z, y, dense.NetSettings())
    from netweave.operators.weights import focal_loss

    rows = [(int(a), float(1 / (1 + np.exp(-min(b, 700))) if b > -700 else 0.0)) for a, b in zip(y, z)]
    want = [r[0] for r in spark.createDataFrame(rows, "label int, score double").select(focal_loss("label", "score")).collect()]
    assert loss.tolist() == pytest.approx(want, abs=1e-9) and np.isfinite(slope).all()


def test_net_learns_a_ring(ring, tmp_path):
    model = mod.focal_net(epochs=40).fit(ring)
    scored = mod.score(model, ring)
    assert evaluate(scored, "label", "score").first()["auc"] > 0.95
    assert model.history[-1] < 0.6 * model.history[0]
    model.write().save(str(tmp_path / "net"))
    back = dense.FocalNetModel.load(str(tmp_path / "net"))
    both = scored.select("row_id", "score").join(mod.score(back, ring, "again").select("row_id", "again"), "row_id")
    assert both.count() == 900 and both.where("abs(score - again) > 1e-12").count() == 0 and back.history == model.history
    more = mod.focal_net().started(model, epochs=2).fit(ring)
    assert more.history[0] < model.history[0]


def test_blocks_do_not_change_the_fit(ring, monkeypatch):
    make = lambda: mod.focal_net(weight="weight", hidden=(8,), epochs=3, batch_rows=300)
    one = make().fit(ring)
    monkeypatch.setattr(dense, "BLOCK_ROWS", 200)
    many = make().fit(ring.repartition(3))
    for a, b in zip(one.parameters, many.parameters):
        assert np.abs(a - b).max() < 1e-8
    assert one.history == pytest.approx(many.history)


def test_steps_write_nothing_and_plan_nothing(spark, ring, monkeypatch):
    """Steps over many blocks read rows that executors hold; a step must not plan or write a table anew."""
    monkeypatch.setattr(dense, "BLOCK_ROWS", 100)
    packed = dense.packed_rows(ring, "row_id", "weight")
    planned = []
    for name in ("mapInArrow", "groupBy", "repartition"):
        plain = getattr(type(ring), name)
        monkeypatch.setattr(type(ring), name, lambda *a, name=name, plain=plain, **k: planned.append(name) or plain(*a, **k))
    settings = dense.NetSettings(hidden=(4,), epochs=3, batch_rows=100)
    many, history = packed.fit(settings)
    assert planned == ["repartition"] and len(history) == 3
    packed.close()
    monkeypatch.setattr(dense, "_PLACES", 2)
    places, _ = dense.fit_net(ring, settings, "row_id", "weight")
    monkeypatch.setattr(dense, "BLOCK_ROWS", 1 << 16)
    one, _ = dense.fit_net(ring, settings, "row_id", "weight")
    for a, b, c in zip(one, many, places):
        assert np.abs(a - b).max() < 1e-8 and np.abs(a - c).max() < 1e-8


@pytest.mark.parametrize("block", [dense.BLOCK_ROWS, 200])
def test_class_weights_of_packed_rows_are_a_weight_column(ring, block, monkeypatch):
    from netweave.operators.weights import with_weight

    monkeypatch.setattr(dense, "BLOCK_ROWS", block)
    classes = {0.0: 0.5, 1.0: 3.0}
    make = lambda: mod.focal_net(weight="class", hidden=(4,), epochs=2, batch_rows=300)
    column = make().fit(with_weight(ring, "label", classes, "class"))
    packed = dense.packed_rows(ring)
    for _ in range(2):
        again = make().fit_packed(packed, classes)
        for a, b in zip(column.parameters, again.parameters):
            assert np.abs(a - b).max() < 1e-8
    packed.close()


def test_weights_count_rows(ring):
    """A row of weight two is two rows."""
    plain = dict(hidden=(4,), epochs=4, batch_rows=10_000, dropout=0.0)
    weighted = mod.focal_net(weight="weight", **plain).fit(ring)
    twice = ring.unionByName(ring.where("weight = 2"))
    repeated = mod.focal_net(**plain).fit(twice)
    for a, b in zip(weighted.parameters, repeated.parameters):
        assert np.abs(a - b).max() < 1e-8


def test_nothing_to_learn_from(ring):
    with pytest.raises(ValueError, match="no rows"):
        mod.focal_net().fit(ring.limit(0))


def test_reweighted_net_goes_on(ring):
    parts = ring.where("row_id % 3 > 0"), ring.where("row_id % 3 = 0")
    fit = mod.reweighted_fit(lambda: mod.focal_net(epochs=2), *parts, rounds=8, patience=8)
    assert len(fit.history) == 8 and set(fit.weights) == {0.0, 1.0}
    assert fit.history[-1]["loss"] < fit.history[0]["loss"]
    assert mod.score(fit.model, ring).where(F.col("score").between(0, 1)).count() == 900


def test_draws_and_batches_are_those_of_the_hashes():
    """Dropout and batches, drawn in pieces, are those of the plain draws of each key."""
    keys = np.random.default_rng(3).integers(0, 1 << 63, 3000).astype(np.uint64)
    settings = dense.NetSettings()
    units = np.arange(64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    plain = dense.drawn(keys[:, None] ^ units, settings.seed + 7, 5) < settings.dropout
    assert (dense.dropped(keys, 64, settings, 0, 5) == plain).all() and 0.19 < plain.mean() < 0.21
    for share in (0.0, 0.3, 1.0):
        assert (dense.drawn_below(keys, 1, 2, share) == (dense.drawn(keys, 1, 2) < share)).all()
    rows = dense.Rows(np.arange(6000.0).reshape(-1, 2), np.ones(3000), np.ones(3000), keys)
    for step, mine in enumerate(rows.batches(7, 42, 1)):
        assert (rows.of(mine).x == rows.batch(7, 42, 1, step).x).all()


def test_a_table_of_a_few_blocks_is_fitted_by_one_task(ring, monkeypatch):
    """A job for each step is left to tables of more than ``WHOLE_BLOCKS`` blocks; the fit is the same."""
    held, plain = [], dense._held
    monkeypatch.setattr(dense, "_held", lambda *a: held.append(a) or plain(*a))
    found = []
    for block, jobs in ((dense.BLOCK_ROWS, 0), (300, 0), (200, 1)):
        monkeypatch.setattr(dense, "BLOCK_ROWS", block)
        found.append(dense.fit_net(ring.repartition(5), dense.NetSettings(hidden=(4,), epochs=3, batch_rows=100), "row_id")[0])
        assert len(held) == jobs
    for other in found[1:]:
        for a, b in zip(found[0], other):
            assert np.abs(a - b).max() < 1e-8


@pytest.mark.parametrize("settings", [dense.NetSettings(), dense.NetSettings(hidden=(5, 3, 2), dropout=0.0, alpha=1.0, gamma=0.0),
                                      dense.NetSettings(hidden=(7,), dropout=0.5, gamma=1.5), dense.NetSettings(hidden=())])
def test_steps_in_the_jvm_are_those_of_numpy(ring, settings):
    """Batches, dropout, class weights, loss and gradient of every step, and what a few epochs lead to."""
    packed = dense.packed_rows(ring.repartition(3), "row_id", "weight")
    rows = [dense._rows(r.asDict(), 3) for r in packed.blocks.collect()]
    whole = dense.Rows(*[np.concatenate([getattr(r, n) for r in rows]) for n in ("x", "y", "w", "key")])
    held, classes = dense._held(packed.blocks, 3), {0.0: 0.5, 1.0: 3.0}
    assert isinstance(held, dense.HeldRows)
    parameters = dense.initial(3, settings)
    for epoch, step, weights in ((0, 0, {}), (2, 3, classes)):
        want = dense.batch_sums(parameters, dense._weighed(whole.batch(4, settings.seed, epoch, step), weights), settings, 4 * epoch + step)
        got = held.summed(parameters, settings, 4, epoch, step, weights)
        assert np.abs(got - want).max() < 1e-9 and got[1] > 0
    few = dense.replace(settings, epochs=3)
    one, losses = dense._fit_one(packed.blocks, 3, parameters, few, 4, classes)
    many, again = held.fit(parameters, few, 4, classes)
    held.unpersist()
    assert losses == pytest.approx(again, abs=1e-9) and len(losses) == 3
    for a, b in zip(one, many, strict=True):
        assert np.abs(a - b).max() < 1e-8
