"""Training of LSTM autoencoders: gradients, losses, shards, and errors against a plain computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fahrwerk.operators import lstm_training as lt
from fahrwerk.sources import files

SCHEMA = "grp string, run_id long, seq long, v array<double>, part string"


def plain(window, layers):
    """The stack's output, number by number."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for w in layers:
        n = len(w["hh"][0])
        h, c, out = [0.0] * n, [0.0] * n, []
        for x in window:
            z = [sum(a * b for a, b in zip(w["ih"][k], x, strict=True)) + sum(a * b for a, b in zip(w["hh"][k], h, strict=True)) + w["b"][k] for k in range(4 * n)]
            c = [sigmoid(z[n + k]) * c[k] + sigmoid(z[k]) * math.tanh(z[2 * n + k]) for k in range(n)]
            h = [sigmoid(z[3 * n + k]) * math.tanh(c[k]) for k in range(n)]
            out.append(h)
        window = out
    return np.array(window)


def test_forward_equals_a_plain_computation():
    sizes = lt.layer_sizes(3, (5, 4))
    assert sizes == [(3, 5), (5, 4), (4, 5), (5, 3)] and lt.layer_sizes(15)[2:4] == [(64, 32), (32, 64)]
    layers = lt.initial(sizes, 3)
    x = np.random.default_rng(1).random((4, 6, 3))
    got, _ = lt.forward(x, layers)
    for k in range(4):
        assert np.allclose(got[k], plain(x[k].tolist(), layers))


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(2)
    sizes = lt.layer_sizes(2, (4, 3))
    vector = lt.flat(lt.initial(sizes, 5))
    x = rng.random((3, 5, 2))

    def loss(v):
        away = lt.forward(x, lt.shaped(v, sizes))[0] - x
        return float((away * away).mean())

    out, kept = lt.forward(x, lt.shaped(vector, sizes))
    got = lt.flat(lt.gradients(lt.shaped(vector, sizes), kept, 2 * (out - x) / x.size))
    for k in range(0, len(vector), 3):
        step = np.zeros_like(vector)
        step[k] = 1e-6
        assert got[k] == pytest.approx((loss(vector + step) - loss(vector - step)) / 2e-6, abs=1e-7)


def waves(spark, many=160, steps=12):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(many):
        t = np.arange(steps) + rng.uniform(0, 6)
        for group, span in (("slow", 0.4), ("fast", 1.1)):
            v = np.stack([10 + 5 * np.sin(span * t), np.cos(span * t)], axis=1)
            rows.append((group, i // 10, i, v.ravel().tolist(), ["train", "train", "train", "validation", "test"][i % 5]))
    rows += [("few", 1, i, [0.0] * 2 * steps, "train") for i in range(20)]
    rows += [("slow", 90, 1, [None] * 2 * steps, "train"), ("slow", 90, 2, [float("nan")] * 2 * steps, "test")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def trained(spark):
    w = waves(spark)
    return w, lt.fit(w, 2, hidden=(12, 6), epochs=25, batch=16, rate=0.01)


def test_losses_fall_on_a_planted_signal(trained):
    _, models = trained
    assert set(models.weights) == {"slow", "fast"}
    for losses in models.losses.values():
        assert len(losses) == 26 and min(losses) < 0.4 * losses[0]


def test_disturbed_windows_stand_out(spark, trained):
    w, models = trained
    test = w.where("part = 'test' and grp = 'slow' and run_id < 90")
    good = np.array([r.error for r in lt.errors(test, models).collect()])
    bad = np.array([r.error for r in lt.errors(test.withColumn("v", F.transform("v", lambda x, i: F.when(i % 7 == 0, -x).otherwise(x))), models).collect()])
    assert bad.mean() > 2 * good.mean()


def test_errors_equal_a_plain_computation(trained):
    w, models = trained
    layers = {g: lt.shaped(v, models.sizes) for g, v in models.weights.items()}
    rows = lt.errors(w, models).collect()
    middle = {(r.grp, r.run_id, r.seq): r.error for r in lt.errors(w, models, middle=True).collect()}
    assert len(rows) == w.count()
    for r in rows:
        if r.grp == "few" or r.run_id == 90:
            assert r.error is None
    for r in [r for r in rows if r.error is not None][::23]:
        x = (np.array(r.v).reshape(-1, 2) - models.low[r.grp]) / (models.high[r.grp] - models.low[r.grp])
        away = np.abs(plain(x.tolist(), layers[r.grp]) - x)
        assert np.allclose(r.error, away.mean(axis=0)) and np.allclose(middle[r.grp, r.run_id, r.seq], away[6])


def test_shards_train_too_and_partitioning_doesnt_matter(spark):
    w = waves(spark, 200)
    one, other = (lt.fit(w.repartition(n), 2, hidden=(8, 4), epochs=8, batch=8, rate=0.03, shard_windows=30) for n in (1, 5))
    for g in ("slow", "fast"):
        assert np.array_equal(one.weights[g], other.weights[g]) and min(one.losses[g]) < 0.8 * one.losses[g][0]


def test_training_stops_early_and_keeps_the_best(spark):
    rng = np.random.default_rng(1)
    rows = [("noise", i, i, rng.random(8).tolist(), ["train", "validation"][i % 2]) for i in range(120)]
    models = lt.fit(spark.createDataFrame(rows, SCHEMA), 2, hidden=(4,), epochs=60, rate=0.5, halve_after=1, stop_after=3)
    losses = models.losses["noise"]
    assert len(losses) < 60 and losses.index(min(losses)) == len(losses) - 4


def test_models_are_saved_as_arrays(spark, trained, tmp_path):
    w, models = trained
    files.save_arrays(spark, models.arrays(), str(tmp_path / "m"))
    w = w.where("run_id < 90")
    back = lt.Models.of(files.load_arrays(spark, str(tmp_path / "m")))
    assert lt.errors(w, back).orderBy("grp", "run_id", "seq").collect() == lt.errors(w, models).orderBy("grp", "run_id", "seq").collect()


def test_no_windows_no_models(spark):
    assert not lt.fit(spark.createDataFrame([], SCHEMA), 2).weights
