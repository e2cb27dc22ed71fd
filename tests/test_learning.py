"""Models against numpy on small tables; gradients against differences; forecasts against a plain filter."""

import math
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import learning, statespace
from vigil.sources.models import ModelStore


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(float(v) if v is not None else None for v in r) for r in zip(*columns.values())], ", ".join(f"{n} double" for n in names)).repartition(3)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-2, 2, 600), rng.uniform(0, 1, 600)
    y = np.sin(2 * a) + b * b + rng.normal(scale=0.05, size=600)
    return frame(spark, a=a, b=b, y=y, t=(rng.uniform(size=600) < 1 / (1 + np.exp(-3 * np.sin(2 * a)))), e=rng.exponential(np.exp(0.5 * a)), h=rng.uniform(size=600) < 0.2, id=np.arange(600)).cache(), a, b, y


def column(df, *names):
    return np.array([tuple(r) for r in df.select(*names).collect()])


def test_random_layers_equal_numpy(spark, table):
    df, a, b, y = table
    models = learning.least_squares_sizes(df.unionByName(df.limit(3).withColumn("a", F.lit(None).cast("double"))), ["a", "b"], "y", [5, 40], ridge=1e-3)
    x = np.column_stack([a, b])
    for p, (layer, w) in models.items():
        h = layer.units(x)
        want = np.linalg.solve(h.T @ h + 1e-3 * np.eye(p + 1), h.T @ y)
        assert np.allclose(w, want, rtol=1e-5, atol=1e-6)
    out = column(learning.predict_layer(df, models[40]), "y", "prediction")
    assert ((out[:, 0] - out[:, 1]) ** 2).mean() < 0.05 * y.var()


def test_splines():
    x = np.linspace(-1, 3, 101)
    b = learning.spline_basis(x, -1, 3, 7)
    assert np.allclose(b.sum(1), 1) and (b >= -1e-12).all() and b.shape == (101, 10) and ((b > 1e-9).sum(1) <= 4).all()
    lines = np.linalg.lstsq(b, np.column_stack([x, x**3]), rcond=None)[0]
    assert np.allclose(b @ lines, np.column_stack([x, x**3]))  # cubics are splines


def test_additive_model(spark, table):
    df, a, b, y = table
    m = learning.additive_model(df, "y", ["a"], ["b"])
    d = m.design(np.column_stack([a, b]))
    want = np.linalg.solve(d.T @ d + m.penalty(0.6), d.T @ y)
    assert np.allclose(m.coefficients, want, atol=1e-6)
    out = column(learning.predict_additive(df, learning.additive_model(df, "y", ["a", "b"])), "a", "b", "prediction")  # b counts by its square
    assert np.abs(out[:, 2] - np.sin(2 * out[:, 0]) - out[:, 1] ** 2).mean() < 0.06
    logit = learning.additive_model(df, "t", ["a"], link="logit")
    p = column(learning.predict_additive(df, logit), "a", "prediction")
    assert logit.steps < 25 and np.abs(p[:, 1] - 1 / (1 + np.exp(-3 * np.sin(2 * p[:, 0])))).mean() < 0.08
    surface = learning.additive_model(df, "y", [("a", "b")], pieces=8, smooth=0.01)
    d = surface.design(np.column_stack([a, b]))
    assert np.allclose(surface.coefficients, np.linalg.solve(d.T @ d + surface.penalty(0.01), d.T @ y), atol=1e-5)
    out = column(learning.predict_additive(df, surface), "a", "b", "prediction")
    assert np.abs(out[:, 2] - np.sin(2 * out[:, 0]) - out[:, 1] ** 2).mean() < 0.1
    with pytest.raises(ValueError):
        learning.additive_model(df.limit(0), "y", ["a"])


def test_margins(spark, table):
    rng = np.random.default_rng(3)
    r, w = np.where(np.arange(500) % 2, 1.0, 2.5) + rng.normal(scale=0.15, size=500), rng.uniform(0, 2 * math.pi, 500)
    rings = frame(spark, x=r * np.cos(w), z=r * np.sin(w), y=np.arange(500) % 2).cache()
    accuracy = lambda m: np.mean([a == b for a, b in column(learning.predict_margin(rings, m), "y", "prediction")])
    assert accuracy(learning.margin_model(rings, ["x", "z"], "y", steps=20)) < 0.75  # no line parts rings
    waves = learning.margin_model(rings, ["x", "z"], "y", gamma=1.0, steps=30)
    assert accuracy(waves) > 0.97 and waves.history[-1] < 0.5 * waves.history[0]
    df, a, *_ = table
    m = learning.margin_model(df, ["a", "b"], "y", loss="epsilon_insensitive", gamma=0.5, epsilon=0.05, steps=50)
    out = column(learning.predict_margin(df, m), "y", "prediction")
    assert np.abs(out[:, 0] - out[:, 1]).mean() < 0.35 * np.abs(out[:, 0] - out[:, 0].mean()).mean()
    thin = learning.margin_model(df, ["a", "b"], "t", penalty="l1", alpha=5.0, steps=5)
    assert (thin.weights[:-1] == 0).all()
    again = learning.margin_model(rings.repartition(8), ["x", "z"], "y", gamma=1.0, steps=5)
    assert np.allclose(again.history, learning.margin_model(rings.coalesce(1), ["x", "z"], "y", gamma=1.0, steps=5).history, rtol=1e-8)


@pytest.mark.parametrize("loss", ["squared", "exponential", "pareto"])
def test_network_gradients(loss):
    rng = np.random.default_rng(2)
    m = learning.Network(["a", "b"], np.zeros(2), np.ones(2), [rng.normal(size=(3, 4)), rng.normal(size=(5, 2 if loss == "pareto" else 1))], loss)
    x, y = rng.normal(size=(30, 2)), rng.exponential(size=30)
    g = m.gradient(x, y)
    flat = np.concatenate([w.ravel() for w in m.layers])
    for i in range(len(flat)):
        ends = []
        for sign in (1, -1):
            moved = flat.copy()
            moved[i] += sign * 1e-6
            n = learning.Network(["a", "b"], np.zeros(2), np.ones(2), [moved[: m.layers[0].size].reshape(m.layers[0].shape), moved[m.layers[0].size :].reshape(m.layers[1].shape)], loss)
            ends.append(n.gradient(x, y)[-2])
        assert abs((ends[0] - ends[1]) / 2e-6 - g[i]) < 1e-4 * max(1, abs(g[i]))


def test_network(spark, table):
    df, a, b, y = table
    m = learning.network(df, ["a", "b"], "y", hidden=(16, 8), rate=0.03, steps=60, held_out=F.col("h") > 0)
    out = column(learning.predict_network(df.where("h > 0"), m), "y", "prediction")
    assert ((out[:, 0] - out[:, 1]) ** 2).mean() < 0.5 * ((out[:, 0] - y.mean()) ** 2).mean()
    assert min(m.history) < 0.5 * m.history[0] and len(m.history) <= 60
    one, eight = (learning.network(df.repartition(n), ["a", "b"], "y", hidden=(4,), steps=3, held_out=F.col("h") > 0) for n in (1, 8))
    assert all(np.allclose(u, v, atol=1e-9) for u, v in zip(one.layers, eight.layers))
    rate = learning.network(df, ["a"], "e", hidden=(), loss="exponential", rate=0.1, steps=60)
    assert rate.layers[0][0, 0] / rate.deviation[0] == pytest.approx(0.5, abs=0.12)


def test_random_search(spark, table):
    df, *_ = table
    space = {"ridge": [1e-6, 1e3], "size": [2, 20], "kind": ["tanh"]}
    fit = lambda d, p: learning.least_squares_sizes(d, ["a"], "y", [p["size"]], ridge=p["ridge"], kind=p["kind"])[p["size"]]
    score = lambda m, d: -learning.predict_layer(d, m).agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0]
    best, results = learning.random_search(df, fit, score, space, "id", n=4, n_folds=2)
    assert best == {"ridge": 1e-6, "size": 20, "kind": "tanh"} and results.count() == 8
    assert learning.sampled(space, 3, 7) == learning.sampled(space, 3, 7) and len({str(s) for s in learning.sampled(space, 99, 1)}) == 4


def test_filter_equals_plain_recursions():
    rng = np.random.default_rng(4)
    y = rng.normal(size=60)
    f, g = statespace.Filter(np.array([0.6]), np.zeros(0)), statespace.Filter(np.zeros(0), np.array([0.5]))
    v, guess = 1 + 0.25, 0.0  # innovations of a moving average: v is the variance, the next guess 0.5 / v * error
    for t, x in enumerate(y):
        assert f.forecast() == pytest.approx(0.6 * y[t - 1] if t else 0.0, abs=1e-12)
        assert g.forecast() == pytest.approx(guess, abs=1e-12)
        error, shape = g.step(x)
        assert shape == pytest.approx(v, abs=1e-10)
        f.step(x)
        guess, v = 0.5 / v * error, 1.25 - 0.25 / v
    one = statespace.deviance(y, np.array([0.6]), np.zeros(0))
    e = np.append(y[0] * math.sqrt(1 - 0.36), y[1:] - 0.6 * y[:-1])
    assert one == pytest.approx(60 * math.log((e**2).sum() / 60) - math.log(1 - 0.36), abs=1e-9)
    assert np.allclose(statespace.product(np.array([-0.5]), np.array([-0.3]), 4), [-0.5, 0, 0, -0.3, 0.15])


def test_seasonal_forecasts(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(6):
        level = np.cumsum(rng.normal(scale=0.05, size=120))
        rows += [(s, t, float(10 * math.sin(2 * math.pi * t / 12) + level[t] + rng.normal(scale=0.1))) for t in range(120)]
    rows += [(90, t, float(t)) for t in range(5)] + [(91, t, None if t == 30 else float(t % 12)) for t in range(60)]
    df = spark.createDataFrame(rows, "series long, t long, v double").repartition(4)
    out = statespace.seasonal_forecasts(df, "series", "t", "v", steps=60)
    got = out.where("series < 6").collect()
    assert len(got) == 6 * 24 and np.mean([(r.v - r.forecast) ** 2 for r in got]) ** 0.5 < 0.4
    assert out.where("series = 90 and forecast is null").count() == 1 and out.where("series = 91").count() == 12
    zeros = statespace.one_step(np.arange(40.0), 30, (0, 1, 0), (0, 1, 0, 12))[0]
    assert np.allclose(zeros, np.arange(30, 40))


def test_model_store(spark, table, tmp_path):
    df, *_ = table
    store = ModelStore(spark, str(tmp_path / "models"))
    model = learning.additive_model(df, "y", ["a"], pieces=4)
    versions, threads = [], [threading.Thread(target=lambda: versions.append(store.save("gam", model, {"pieces": 4}, {"rmse": 0.5}))) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(versions) == list(range(1, 9)) == store.versions("gam")
    loaded, about = store.load("gam", 3)
    assert about["version"] == 3 and about["parameters"] == {"pieces": 4} and (loaded.coefficients == model.coefficients).all()
    os.makedirs(tmp_path / "models" / "gam" / "9")  # a writer that died
    open(tmp_path / "models" / "gam" / "9" / "claim", "w").close()
    assert store.load("gam")[1]["version"] == 8 and store.save("gam", model) == 10 and store.table().count() == 9
    with pytest.raises(KeyError):
        store.load("gam", 9)


def test_fits_pass_over_packed_runs(spark, monkeypatch):
    """Rows are stored once in blocks of runs: features are worked out once a run, whatever the order of rows, and the store is emptied; null and NaN rows stay out."""
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 4, 900) * 1.0, rng.integers(0, 3, 900) * 1.0
    y = a - b * b + rng.normal(scale=0.1, size=900)
    rows = [(float(p), float(q), float(v)) for p, q, v in zip(a, b, y)] + [(None, 1.0, 1.0), (1.0, float("nan"), 1.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    packed = learning.blocks(df, ["a", "b", "y"])
    assert packed.count() == 3 and packed.agg(F.sum("runs")).first()[0] == 36
    s = learning.block_sums(packed, 2, lambda u, lengths, v: np.array([lengths.sum(), lengths @ u[:, 0], lengths @ u[:, 1], v.sum(), np.repeat(u[:, 0], lengths) @ v]), 5)
    assert np.allclose(s, [900, a.sum(), b.sum(), y.sum(), a @ y])
    mean, deviation = learning.block_moments(packed, 2)
    assert np.allclose(mean, [a.mean(), b.mean(), y.mean()]) and np.allclose(deviation, [a.std(), b.std(), y.std()])
    learning.drop_cut(packed)
    left = []
    monkeypatch.setattr(learning, "drop_cut", lambda d: left.append(d))
    m = learning.margin_model(df, ["a", "b"], "y", loss="epsilon_insensitive", gamma=0.5, features=6, steps=3)
    x, at = np.column_stack([a, b]), learning.Margin(m.columns, m.mean, m.deviation, m.waves, m.phases, np.zeros(7), m.loss, m.middle, m.spread)
    off = np.abs((y - at.middle) / at.spread) - 0.1 / at.spread
    assert m.history[0] == pytest.approx(np.maximum(off, 0).mean()) and len(m.history) == 4 and np.isfinite(at.score(x)).all()
    n = learning.network(df, ["a", "b"], "y", hidden=(3,), steps=2, held_out=F.col("a") == 3)
    test = a == 3
    assert np.allclose(n.mean, x[~test].mean(0)) and np.allclose(n.deviation, x[~test].std(0)) and n.middle == pytest.approx(y[~test].mean())
    assert len(left) == 2
    g = n.gradient(x, y)
    order = np.lexsort((b, a))
    assert np.allclose(g, n.gradient(x[order], y[order]))
    assert n.run_gradient(x[:0], np.zeros(0, int), y[:0])[-1] == 0
    for fit in (learning.margin_model, learning.network):
        with pytest.raises(ValueError):
            fit(df.limit(0), ["a", "b"], "y")
