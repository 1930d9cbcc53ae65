"""The network's gradients, the rules of training, and that neither depends on how examples are dealt out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.learning import training
from strandworks.learning.network import Network


def some(n, network, seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, network.height, network.width)), np.eye(network.classes)[rng.integers(0, network.classes, n)] * 0.9 + 0.1 / network.classes, rng.random(n)


@pytest.mark.parametrize("network", [Network(5, 4, 3), Network(1, 1, 2, 2, 1), Network(4, 6, 2, 3, 3)])
def test_gradients_are_differences(network):
    x, t, w = some(7, network)
    flat = network.flat(network.initial(1))
    assert len(flat) == network.size() and (network.flat(network.named(flat)) == flat).all()
    flat = flat + np.random.default_rng(3).standard_normal(len(flat)) * 0.1  # off the kinks
    loss, gradient = network.gradients(network.named(flat), x, t, w)
    for i in np.random.default_rng(2).integers(0, len(flat), 60):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        slope = (network.gradients(network.named(flat + step), x, t, w)[0] - network.gradients(network.named(flat - step), x, t, w)[0]) / 2e-6
        assert abs(slope - gradient[i]) < 1e-4 * max(1, abs(slope))
    chance = network.chances(network.named(flat), x)
    assert np.allclose(chance.sum(1), 1) and np.isclose(loss, -(np.log(chance) * t * w[:, None]).sum())
    parts = [network.gradients(network.named(flat), x[a:b], t[a:b], w[a:b]) for a, b in ((0, 3), (3, 3), (3, 7))]
    assert np.allclose(sum(p[1] for p in parts), gradient) and np.isclose(sum(p[0] for p in parts), loss)


def test_rules_of_a_step():
    plan = training.Plan(epochs=(2, 3), rates=(0.1, 0.01), steps=5, decay=0.5)
    assert plan.rate(0, 0) == 0.1 and np.isclose(plan.rate(0, 5), 0.05) and np.isclose(plan.rate(0, 10), 0) and plan.rate(1, 0) == 0.01
    weights, free = np.array([1.0, -2.0, 3.0]), np.array([True, True, False])
    adam = training.Adam(plan, 3)
    moved = adam.moved(weights, np.array([300.0, 400.0, 1e9]), 0.1, free)
    assert np.allclose(adam.mean, [0.1 * 3, 0.1 * 4, 0])  # clipped to a norm of 5, the frozen part left out
    assert np.allclose(moved, [1 - 0.1 * (1 + 0.5), -2 - 0.1 * (1 - 1.0), 3])  # decay beside the step of size one
    small = training.Adam(plan, 3)
    small.moved(weights, np.array([0.3, 0.4, 0.0]), 0.1, free)
    assert np.allclose(small.mean, [0.03, 0.04, 0])


def examples(spark, n=400, seed=3):
    """Grids of noise with a bright column, which is the label."""
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((n, 4, 5)) * 0.3, rng.integers(0, 3, n)
    for k in range(n):
        x[k, :, y[k] + 1] += 1
    return spark.createDataFrame([(k, x[k].ravel().tolist(), "abc"[y[k]], k % 5 == 0) for k in range(n)], "key long, grid array<double>, label string, held_out boolean")


@pytest.fixture(scope="module")
def trained(spark):
    return training.train(examples(spark), Network(4, 5, 3), list("abc"), training.Plan(epochs=(1, 4), steps=4), parts=1)


def test_it_learns_and_predicts(spark, trained):
    assert trained.history[-1]["val_accuracy"] > 0.95 and sum(r["best"] for r in trained.history) == 1
    assert [r["phase"] for r in trained.history] == ["head"] + ["all"] * 4
    fresh = examples(spark, 150, 9).withColumn("confidence", F.lit("x"))
    got = training.predicted(fresh, trained)
    assert got.where("label = pred").count() > 0.95 * 150 and got.where("confidence between 0.34 and 1").count() > 140
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [0.0] * 20)], "key long, grid array<double>")
    assert [(r["key"], r["pred"] is None, r["confidence"] is None) for r in training.predicted(odd, trained).orderBy("key").collect()] == [(1, True, True), (2, True, True), (3, False, False)]


def test_parts_make_no_difference(spark, trained):
    df = examples(spark)
    again = training.train(df.repartition(7), trained.network, trained.classes, training.Plan(epochs=(1, 4), steps=4), parts=4)
    assert np.abs(again.weights - trained.weights).max() < 1e-9
    assert [r["val_accuracy"] for r in again.history] == [r["val_accuracy"] for r in trained.history]


def test_first_phase_leaves_the_backbone(spark):
    network = Network(4, 5, 3)
    plan = training.Plan(epochs=(2, 0), steps=2)
    model = training.train(examples(spark, 100), network, list("abc"), plan)
    start, held = network.flat(network.initial(plan.seed)), network.backbone()
    assert (model.weights[held] == start[held]).all() and not (model.weights[~held] == start[~held]).any()


def test_odd_examples(spark):
    df = examples(spark, 60).unionByName(spark.createDataFrame([(None, [0.0] * 20, "a", False), (1, None, "a", False), (2, [1.0], "b", None), (3, [0.0] * 20, None, False), (4, [0.0] * 20, "z", False)], "key long, grid array<double>, label string, held_out boolean"))
    plan = training.Plan(epochs=(1, 0), steps=2)
    both = [training.train(d, Network(4, 5, 3), list("abc"), plan).weights for d in (df, examples(spark, 60))]
    assert np.abs(both[0] - both[1]).max() < 1e-9
    with pytest.raises(ValueError, match="no examples"):
        training.train(df.where("false"), Network(4, 5, 3), list("abc"), plan)
    with pytest.raises(ValueError, match="classes"):
        training.train(df, Network(4, 5, 3), ["a", "a", "b"], plan)
    none_held = training.train(examples(spark, 60).withColumn("held_out", F.lit(False)), Network(4, 5, 3), list("abc"), plan)
    assert none_held.history[0]["val_accuracy"] is None and none_held.history[0]["best"]


def test_grids_go_through_the_network_a_slice_at_a_time(spark):
    class Limited(Network):
        def scores(self, p, x):
            if len(x) > 64:
                raise ValueError("too many grids at once")
            return super().scores(p, x)

    df = examples(spark, 600)
    model = training.train(df, Limited(4, 5, 3), list("abc"), training.Plan(epochs=(1, 0), steps=2), parts=1)
    assert training.predicted(df.repartition(1), model).where("pred is not null").count() == 600


def test_all_rows_count_in_training(spark):
    n, network = 210_000, Network(1, 1, 2, 1, 1)
    x = F.pmod(F.col("id") * 37, F.lit(1009)) / 1009
    df = spark.range(n).select(F.col("id").alias("key"), F.array(x).alias("grid"), F.when(x < 0.3, "a").otherwise("b").alias("label"), (F.col("id") % 10 == 0).alias("held_out"))
    plan = training.Plan(epochs=(1, 0), steps=1)
    got = training.train(df, network, list("ab"), plan)
    keys = np.arange(n)
    grids = keys * 37 % 1009 / 1009
    labels, held = (grids >= 0.3).astype(int), keys % 10 == 0
    targets = np.eye(2)[labels] * (1 - plan.smoothing) + plan.smoothing / 2

    def judged(flat, rows):
        chance = network.chances(network.named(flat), grids[rows].reshape(-1, 1, 1))
        return -(targets[rows] * np.log(chance)).sum() / rows.sum(), (chance.argmax(1) == labels[rows]).mean()

    start, history = network.flat(network.initial(plan.seed)), got.history[0]
    assert np.allclose([history["loss"], history["accuracy"]], judged(start, ~held), rtol=0, atol=1e-10)
    assert np.allclose([history["val_loss"], history["val_accuracy"]], judged(got.weights, held), rtol=0, atol=1e-10)
    each = (~held).sum() / (2 * np.bincount(labels[~held]))
    _, gradient = network.gradients(network.named(start), grids[~held].reshape(-1, 1, 1), targets[~held], each[labels[~held]])
    moved = training.Adam(plan, len(start)).moved(start, gradient / each[labels[~held]].sum(), plan.rate(0, 0), ~network.backbone())
    assert np.abs(got.weights - moved).max() < 1e-9


def test_parts_grow_with_the_rows_and_their_sums_are_added_up_by_tasks(spark, trained, monkeypatch):
    assert [training.parts_of(n) for n in (0, 1, 501, 32_000, 320_000, 320_001, 3_000_000)] == [1, 1, 2, 64, 64, 65, 600]
    monkeypatch.setattr(training, "MOST_SUMS", 3)
    rows = spark.createDataFrame([(k, np.array([k, 1.0]).tobytes()) for k in range(20)], "part int, sums binary").repartition(5)
    got = [np.frombuffer(r["sums"]) for r in training.added(rows).collect()]
    assert len(got) <= 3 and np.sum(got, 0).tolist() == [190, 20]
    again = training.train(examples(spark), trained.network, trained.classes, training.Plan(epochs=(1, 4), steps=4), parts=10)
    assert np.abs(again.weights - trained.weights).max() < 1e-9 and len(again.history) == 5
