"""Models whose fit is a sum over rows: each step is one distributed pass that adds up what its rows say, and only those sums
(as many numbers as the model has parameters, or their square for least squares) come to the driver. Margins and networks
store their numbers first, in packed blocks, and work out rows of equal features once a run.

* ``least_squares_sizes``: random hidden layers with ridge output weights, all sizes from one Gram matrix;
* ``additive_model``: penalised B-splines of one or two columns with an identity or logit link, by weighted normal equations;
* ``margin_model``: hinge or epsilon-insensitive loss, by choice on random Fourier features, with l1, l2 or elastic-net penalty;
* ``network``: a feed-forward regressor with squared, exponential or Pareto loss and early stopping;
* ``random_search``: sampled parameters over folds, fitted concurrently.

Rows with a null feature or target take no part in a fit and are predicted null. Fits of no rows raise. The functions that
workers run travel with this module, so workers need no copy of this package.
"""

from __future__ import annotations

import math
import random
import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.shared import cut, drop_cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _matrix(batch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) if batch.num_columns else np.zeros((batch.num_rows, 0))


def _numbers(df: DataFrame, columns: list) -> DataFrame:
    """Complete rows of ``columns`` (names or expressions) as doubles."""
    named = [(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    return df.select(*named).dropna()


def _batch(total: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])


def _added(parts: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def row_sums(df: DataFrame, columns: list, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of the ``size`` numbers that ``of`` gives for a block of rows (a matrix of ``columns``).

    A task adds up its blocks and sends one array; arrays are added by position, partially before the shuffle, so the driver
    gets ``size`` numbers whatever the number of tasks.
    """

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch))
        yield _batch(total)

    return _added(_numbers(df, columns).mapInArrow(run, "s array<double>"), size)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal rows start, and their lengths."""
    new = np.ones(len(x), bool)
    new[1:] = False
    for c in x.T:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(starts, append=len(x))


def _run_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(lengths) - lengths, axis=0) if len(values) else values


def blocks(df: DataFrame, columns: list) -> DataFrame:
    """Complete rows of ``columns`` (the target last) stored once for the passes of a fit, an Arrow batch in one packed row.

    Rows are sorted where they lie, so that equal features follow each other: a block has a row of features for each run, the run's
    length, and every row's target. What only depends on features is then found once a run, and a pass moves few large rows.
    """
    import pyarrow as pa

    k = len(columns) - 1

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                starts, lengths = runs(x[:, :k])
                body = np.concatenate([lengths, x[starts, :k].T.ravel(), x[:, k]]).astype(np.float64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([len(starts)], pa.int32()), pa.array([body], pa.binary())], ["runs", "body"])

    rows = _numbers(df, columns).sortWithinPartitions(*[f"c{i}" for i in range(k)]) if k else _numbers(df, columns)
    return cut(rows.mapInArrow(pack, "runs int, body binary"), "blocks", 64)


def block_sums(packed: DataFrame, features: int, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """``row_sums`` over ``blocks``: ``of`` gets the features of runs, the runs' lengths and the targets of all their rows."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for m, body in zip(batch.column(0), batch.column(1)):
                m, flat = m.as_py(), np.frombuffer(body.as_buffer(), np.float64)
                total += of(flat[m : m + m * features].reshape(features, m).T, flat[:m].astype(np.int64), flat[m + m * features :])
        yield _batch(total)

    return _added(packed.mapInArrow(run, "s array<double>"), size)


def block_moments(packed: DataFrame, features: int, only: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``moments`` of the features and the target of ``blocks``; ``only`` picks runs and leaves out their last feature."""
    some, k = only or (lambda *block: block), features + (only is None)

    def first(*block):
        u, lengths, y = some(*block)
        return np.concatenate([[len(y)], lengths @ u, [y.sum()]])

    s = block_sums(packed, features, first, k + 1)
    if not s[0]:
        raise ValueError("no complete row to learn from")
    mean = s[1:] / s[0]

    def second(*block):
        u, lengths, y = some(*block)
        return np.append(lengths @ (u - mean[:-1]) ** 2, ((y - mean[-1]) ** 2).sum())

    v = block_sums(packed, features, second, k) / s[0]
    return mean, np.where(v > 0, np.sqrt(v), 1.0)


def with_prediction(df: DataFrame, columns: list[str], predict: Callable[[np.ndarray], np.ndarray], name: str = "prediction") -> DataFrame:
    """``df`` with the numbers that ``predict`` gives for its complete rows, else null."""

    @F.pandas_udf("double")
    def apply(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(np.float64, na_value=np.nan) for p in parts])
        out, whole = np.full(len(x), np.nan), ~np.isnan(x).any(axis=1)
        if whole.any():
            out[whole] = predict(x[whole])
        return pd.Series(out).astype(object).where(whole, None)

    return df.withColumn(name, apply(*[F.col(c).cast("double") for c in columns]))


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of complete rows; a constant column has 1."""
    k = len(columns)
    s = row_sums(df, columns, lambda x: np.concatenate([[len(x)], x.sum(0)]), k + 1)
    if not s[0]:
        raise ValueError("no complete row to learn from")
    mean = s[1:] / s[0]
    v = row_sums(df, columns, lambda x: ((x - mean) ** 2).sum(0), k) / s[0]
    return mean, np.where(v > 0, np.sqrt(v), 1.0)


# --- random hidden layers -------------------------------------------------------------------------


@dataclass
class Hidden:
    """A random layer: the first ``size`` units of seeded weights, of standardised columns."""

    columns: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    kind: str = "sigmoid"

    def units(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - self.mean) / self.deviation, np.ones(len(x))]) @ self.weights
        h = {"sigmoid": lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500))), "tanh": np.tanh, "relu": lambda v: np.maximum(v, 0)}[self.kind](z)
        return np.column_stack([h, np.ones(len(x))])


def least_squares_sizes(df: DataFrame, columns: list[str], target: str, sizes: list[int], ridge: float = 1e-6, kind: str = "sigmoid", seed: int = 0) -> dict[int, tuple[Hidden, np.ndarray]]:
    """For each size a random hidden layer and its ridge output weights (the last one the constant's).

    Layers are nested (the first units of the largest), so all are solved from parts of one Gram matrix that one pass adds up.
    """
    top = max(sizes)
    mean, deviation = moments(df, columns)
    layer = Hidden(columns, mean, deviation, np.random.default_rng(seed).normal(size=(len(columns) + 1, top)), kind)

    def gram(x):
        h = np.column_stack([layer.units(x[:, :-1]), x[:, -1]])
        return (h.T @ h).ravel()

    g = row_sums(df, [*columns, target], gram, (top + 2) ** 2).reshape(top + 2, top + 2)
    out = {}
    for p in sizes:
        use = [*range(p), top]
        a = g[np.ix_(use, use)] + ridge * np.eye(p + 1)
        out[p] = Hidden(columns, mean, deviation, layer.weights[:, :p], kind), np.linalg.solve(a, g[use, top + 1])
    return out


def predict_layer(df: DataFrame, model: tuple[Hidden, np.ndarray], name: str = "prediction") -> DataFrame:
    layer, weights = model
    return with_prediction(df, layer.columns, lambda x: layer.units(x) @ weights, name)


# --- additive models ------------------------------------------------------------------------------


def spline_basis(x: np.ndarray, low: float, high: float, pieces: int, degree: int = 3) -> np.ndarray:
    """B-splines on equal pieces of [low, high] (``pieces + degree`` columns); values outside count as the nearer end."""
    step = (high - low) / pieces or 1.0
    t = (np.clip(x, low, high) - low) / step
    cell = np.minimum(np.floor(t).astype(int), pieces - 1)
    u = t - cell
    local = np.ones((len(x), 1))
    for d in range(1, degree + 1):  # each spline of a degree is shared out to two of the next
        grown = np.zeros((len(x), d + 1))
        for j in range(d):
            grown[:, j] += local[:, j] * (1 + j - u) / d
            grown[:, j + 1] += local[:, j] * (u + d - 1 - j) / d
        local = grown
    out = np.zeros((len(x), pieces + degree))
    for j in range(degree + 1):
        out[np.arange(len(x)), cell + j] += local[:, j]
    return out


@dataclass
class Additive:
    """Terms (columns, their ranges, pieces), coefficients and link of an additive model."""

    terms: list[tuple[tuple[str, ...], tuple[tuple[float, float], ...], int]]
    link: str
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: int = 0

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for names, *_ in self.terms for c in names))

    def design(self, x: np.ndarray) -> np.ndarray:
        at = {c: i for i, c in enumerate(self.columns)}
        parts = [np.ones((len(x), 1))]
        for names, spans, pieces in self.terms:
            if not pieces:
                parts.append(x[:, [at[names[0]]]])
                continue
            basis = [spline_basis(x[:, at[c]], lo, hi, pieces) for c, (lo, hi) in zip(names, spans)]
            parts.append(basis[0] if len(basis) == 1 else (basis[0][:, :, None] * basis[1][:, None, :]).reshape(len(x), -1))
        return np.concatenate(parts, axis=1)

    def penalty(self, smooth: float) -> np.ndarray:
        """Squares of second differences of neighbouring coefficients, and a trace of a ridge that settles what terms share."""
        blocks = [np.zeros((1, 1))]
        for names, _, pieces in self.terms:
            k = pieces + 3
            d = np.diff(np.eye(k), 2, axis=0)
            one = d.T @ d
            blocks.append(np.zeros((1, 1)) if not pieces else smooth * one if len(names) == 1 else smooth * (np.kron(one, np.eye(k)) + np.kron(np.eye(k), one)))
        n = sum(len(b) for b in blocks)
        out, i = np.eye(n) * 1e-8, 0
        for b in blocks:
            out[i : i + len(b), i : i + len(b)] += b
            i += len(b)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        eta = self.design(x) @ self.coefficients
        return 1 / (1 + np.exp(-np.clip(eta, -500, 500))) if self.link == "logit" else eta


def additive_model(df: DataFrame, target: str, splines: list, linear: list[str] = (), link: str = "identity", pieces: int = 10, smooth: float = 0.6, steps: int = 25) -> Additive:
    """A fitted ``Additive``: a smooth function for each of ``splines`` (a column, or a pair for a surface) and a slope for each of ``linear``.

    The logit link is fitted by iterated weighted least squares, a pass a step, until no coefficient moves by more than 1e-8.
    """
    if link not in ("identity", "logit"):
        raise ValueError(f"unknown link {link!r}")
    smooth_columns = [(t,) if isinstance(t, str) else tuple(t) for t in splines]
    flat = list(dict.fromkeys(c for t in smooth_columns for c in t))
    row = _numbers(df, [*flat, *linear, target]).agg(F.count("*").alias("n"), *[f(f"c{i}").alias(f"{n}{i}") for i in range(len(flat)) for n, f in (("a", F.min), ("b", F.max))]).first()
    if not row["n"]:
        raise ValueError("no complete row to learn from")
    span = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(flat)}
    model = Additive([(t, tuple(span[c] for c in t), pieces) for t in smooth_columns] + [((c,), ((0.0, 0.0),), 0) for c in linear], link)
    k = len(model.penalty(smooth))
    model.coefficients = np.zeros(k)
    penalty, columns = model.penalty(smooth), [*model.columns, target]
    for _ in range(steps if link == "logit" else 1):

        def normal(x, model=model):
            d, y = model.design(x[:, :-1]), x[:, -1]
            if model.link == "identity":
                return np.concatenate([(d.T @ d).ravel(), d.T @ y])
            eta = d @ model.coefficients
            mu = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
            w = np.maximum(mu * (1 - mu), 1e-10)
            return np.concatenate([((d * w[:, None]).T @ d).ravel(), d.T @ (w * eta + y - mu)])

        s = row_sums(df, columns, normal, k * k + k)
        after = np.linalg.solve(s[: k * k].reshape(k, k) + penalty, s[k * k :])
        moved = np.abs(after - model.coefficients).max()
        model = Additive(model.terms, link, after, model.steps + 1)
        if moved < 1e-8:
            break
    return model


def predict_additive(df: DataFrame, model: Additive, name: str = "prediction") -> DataFrame:
    return with_prediction(df, model.columns, model.predict, name)


# --- margins --------------------------------------------------------------------------------------


@dataclass
class Margin:
    """Weights (the constant's last) over standardised columns or, with ``waves``, their random Fourier features."""

    columns: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    waves: np.ndarray | None
    phases: np.ndarray | None
    weights: np.ndarray
    loss: str
    middle: float = 0.0
    spread: float = 1.0
    history: list[float] = field(default_factory=list)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.deviation
        if self.waves is not None:
            z = math.sqrt(2 / self.waves.shape[1]) * np.cos(z @ self.waves + self.phases)
        return np.column_stack([z, np.ones(len(z))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.middle + self.spread * (self.features(x) @ self.weights)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.score(x) > 0).astype(float) if self.loss == "hinge" else self.score(x)


def margin_model(df: DataFrame, columns: list[str], target: str, loss: str = "hinge", gamma: float | None = None, features: int = 100, penalty: str = "l2", alpha: float = 1e-4, l1_ratio: float = 0.15, epsilon: float = 0.1, steps: int = 60, seed: int = 0) -> Margin:
    """A support vector machine (``hinge``: target 0 or 1; ``epsilon_insensitive``: a number) by sub-gradients over all rows.

    With ``gamma`` the columns are mapped to ``features`` random waves that stand for the kernel exp(-gamma * squared distance). Each
    A number is learnt as its deviation from the mean in units of its spread (``epsilon`` is in the number's own unit). Each
    step is one pass; steps are scaled by the sums of squared gradients (AdaGrad) and the l1 part is taken by soft
    thresholds, so weights reach 0. ``history`` holds the penalised mean loss before each step; the best weights are kept.
    """
    if loss not in ("hinge", "epsilon_insensitive") or penalty not in ("l1", "l2", "elasticnet"):
        raise ValueError(f"unknown loss {loss!r} or penalty {penalty!r}")
    share = {"l1": 1.0, "l2": 0.0, "elasticnet": l1_ratio}[penalty]
    packed = blocks(df, [*columns, target])
    mean, deviation = block_moments(packed, len(columns))
    middle, spread = (0.0, 1.0) if loss == "hinge" else (float(mean[-1]), float(deviation[-1]))
    mean, deviation, epsilon = mean[:-1], deviation[:-1], epsilon / spread
    rng = np.random.default_rng(seed)
    waves = rng.normal(scale=math.sqrt(2 * gamma), size=(len(columns), features)) if gamma else None
    phases = rng.uniform(0, 2 * math.pi, features) if gamma else None
    k = (features if gamma else len(columns)) + 1
    model = Margin(list(columns), mean, deviation, waves, phases, np.zeros(k), loss, middle, spread)
    best, rate, grown = (math.inf, model.weights), 0.5 if gamma else 0.3, np.zeros(k)
    for _ in range(steps + 1):

        def gradient(u, lengths, y, w=model.weights, shape=model):
            z = shape.features(u)
            told = np.repeat(z @ w, lengths)
            if shape.loss == "hinge":
                sign = np.where(y > 0, 1.0, -1.0)
                short = 1 - sign * told
                slope, value = np.where(short > 0, -sign, 0.0), np.maximum(short, 0).sum()
            else:
                off = told - (y - shape.middle) / shape.spread
                slope, value = np.where(np.abs(off) > epsilon, np.sign(off), 0.0), np.maximum(np.abs(off) - epsilon, 0).sum()
            return np.concatenate([_run_sums(slope, lengths) @ z, [value, len(y)]])

        s = block_sums(packed, len(columns), gradient, k + 2)
        w = model.weights[:-1]
        value = s[k] / s[k + 1] + alpha * (share * np.abs(w).sum() + (1 - share) / 2 * (w**2).sum())
        model.history.append(float(value))
        if value < best[0]:
            best = value, model.weights.copy()
        g = s[:k] / s[k + 1] + np.append(alpha * (1 - share) * w, 0.0)
        grown += g * g
        pace = rate / (np.sqrt(grown) + 1e-12)
        after = model.weights - pace * g
        after[:-1] = np.sign(after[:-1]) * np.maximum(np.abs(after[:-1]) - pace[:-1] * alpha * share, 0)
        model.weights = after
    drop_cut(packed)
    model.weights = best[1]
    return model


def predict_margin(df: DataFrame, model: Margin, name: str = "prediction") -> DataFrame:
    return with_prediction(df, model.columns, model.predict, name)


# --- networks -------------------------------------------------------------------------------------


@dataclass
class Network:
    """Layers (weights with the constants' row last) of ReLU units and a linear output, on standardised columns."""

    columns: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    layers: list[np.ndarray]
    loss: str
    middle: float = 0.0
    spread: float = 1.0
    history: list[float] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        h, kept = (x - self.mean) / self.deviation, []
        for i, w in enumerate(self.layers):
            kept.append(np.column_stack([h, np.ones(len(h))]))
            h = kept[-1] @ w
            if i + 1 < len(self.layers):
                h = np.maximum(h, 0)
        return h, kept

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean of what the output stands for."""
        z = self.raw(x)[0]
        if self.loss == "squared":
            return self.middle + self.spread * z[:, 0]
        one = np.exp(np.clip(z[:, 0], -30, 30))
        if self.loss == "exponential":
            return one
        shape = 1 + np.exp(np.clip(z[:, 1], -30, 30))
        return one / (shape - 1)

    def loss_and_slope(self, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss of each row and its slope in each output.

        ``exponential``: the negative log-likelihood of an exponential law of mean exp(z). ``pareto``: that of a Pareto law of the second
        kind with scale exp(z0) and shape 1 + exp(z1), whose mean is finite.
        """
        if self.loss == "squared":
            d = z[:, 0] - (y - self.middle) / self.spread
            return d * d / 2, d[:, None]
        a = np.clip(z[:, 0], -30, 30)
        if self.loss == "exponential":
            ratio = y * np.exp(-a)
            return a + ratio, (1 - ratio)[:, None]
        s, more = np.exp(a), np.exp(np.clip(z[:, 1], -30, 30))
        k, far = 1 + more, np.log1p(y / s)
        return -np.log(k) + a + (k + 1) * far, np.column_stack([1 - (k + 1) * (y / s) / (1 + y / s), more * (far - 1 / k)])

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums over rows of the slopes in all weights, then of the loss and of 1."""
        starts, lengths = runs(x)
        return self.run_gradient(x[starts], lengths, y)

    def run_gradient(self, u: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``gradient`` of runs of equal rows, each of which passes the layers once."""
        z, kept = self.raw(u)
        value, delta = self.loss_and_slope(np.repeat(z, lengths, axis=0), y)
        delta = _run_sums(delta, lengths)
        out = []
        for i in range(len(self.layers) - 1, -1, -1):
            out.append((kept[i].T @ delta).ravel())
            if i:
                delta = (delta @ self.layers[i][:-1].T) * (kept[i][:, :-1] > 0)
        return np.concatenate([*out[::-1], [value.sum(), len(y)]])


def network(df: DataFrame, columns: list[str], target: str, hidden: tuple[int, ...] = (50, 25, 10), loss: str = "squared", rate: float = 0.01, steps: int = 200, patience: int = 15, held_out: Column | None = None, seed: int = 42) -> Network:
    """A fitted ``Network`` by Adam over gradients of all rows, a pass a step.

    ``held_out`` (by default a hash of the row picks a tenth) marks rows that only judge: after ``patience`` steps without a better
    loss there the fit ends, and the best weights are kept. For the squared loss the target is learnt in units of its spread. ``history`` has the held-out loss of each step. Targets of the
    likelihoods must not be negative.
    """
    outputs = {"squared": 1, "exponential": 1, "pareto": 2}
    if loss not in outputs:
        raise ValueError(f"unknown loss {loss!r}; there are {sorted(outputs)}")
    names = [*columns, target]
    judged = F.coalesce(held_out if held_out is not None else F.pmod(F.xxhash64(*names), F.lit(10)) == 0, F.lit(False)).cast("double")
    packed, width = blocks(df, [*columns, judged, target]), len(columns) + 1

    def rows_of(u, lengths, y, judging=False):
        use = (u[:, -1] > 0) == judging
        return u[use, :-1], lengths[use], y[np.repeat(use, lengths)]

    mean, deviation = block_moments(packed, width, rows_of)
    middle, spread = (float(mean[-1]), float(deviation[-1])) if loss == "squared" else (0.0, 1.0)
    mean, deviation = mean[:-1], deviation[:-1]
    rng = np.random.default_rng(seed)
    sizes = [len(columns), *hidden, outputs[loss]]
    layers = [np.vstack([rng.normal(scale=math.sqrt(2 / a), size=(a, b)), np.zeros((1, b))]) for a, b in zip(sizes, sizes[1:])]
    model = Network(list(columns), mean, deviation, layers, loss, middle, spread)
    k = sum(w.size for w in layers)
    first, second, best, since = np.zeros(k), np.zeros(k), (math.inf, layers), 0
    for step in range(1, steps + 1):

        def sums(*block, shape=model):
            u, lengths, y = rows_of(*block, judging=True)
            value = shape.loss_and_slope(np.repeat(shape.raw(u)[0], lengths, axis=0), y)[0]
            return np.concatenate([shape.run_gradient(*rows_of(*block)), [value.sum(), len(y)]])

        s = block_sums(packed, width, sums, k + 4)
        if not s[k + 1]:
            raise ValueError("no complete row to learn from")
        value = s[k + 2] / s[k + 3] if s[k + 3] else s[k] / s[k + 1]
        model.history.append(float(value))
        if value < best[0]:
            best, since = (value, [w.copy() for w in model.layers]), 0
        elif (since := since + 1) >= patience:
            break
        g = s[:k] / s[k + 1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        after, at = [], 0
        for w in model.layers:
            after.append(w - move[at : at + w.size].reshape(w.shape))
            at += w.size
        model.layers = after
    drop_cut(packed)
    model.layers = best[1]
    return model


def predict_network(df: DataFrame, model: Network, name: str = "prediction") -> DataFrame:
    return with_prediction(df, model.columns, model.predict, name)


# --- search ---------------------------------------------------------------------------------------


def sampled(space: dict[str, list], n: int, seed: int) -> list[dict]:
    """``n`` different combinations of a space's values (all of them, if there are fewer), the same for a seed."""
    names, total = sorted(space), math.prod(len(v) for v in space.values())
    out = []
    for i in random.Random(seed).sample(range(total), min(n, total)):
        one = {}
        for c in names:
            i, k = divmod(i, len(space[c]))
            one[c] = space[c][k]
        out.append(one)
    return out


def folds(df: DataFrame, key: str, n: int, salt: str = "fold") -> Column:
    """A row's fold of ``n``, by a hash of its key."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(key).cast("string")), F.lit(n)).cast("int")


def random_search(df: DataFrame, fit: Callable[[DataFrame, dict], object], score: Callable[[object, DataFrame], float], space: dict[str, list], key: str, n: int = 10, n_folds: int = 3, seed: int = 0, workers: int = 4) -> tuple[dict, DataFrame]:
    """The sampled parameters of the best mean score over folds, and a table (candidate, parameters, fold, score).

    ``fit`` learns from the rows of the other folds, ``score`` judges on the fold's (higher is better). Fits are independent jobs
    that the driver starts ``workers`` at a time; equal means go to the earlier candidate.
    """
    marked = df.withColumn("_fold", folds(df, key, n_folds)).cache()
    candidates = sampled(space, n, seed)

    def one(task):
        i, f = task
        model = fit(marked.where(F.col("_fold") != f).drop("_fold"), candidates[i])
        return i, f, float(score(model, marked.where(F.col("_fold") == f).drop("_fold")))

    try:
        with ThreadPoolExecutor(workers) as pool:
            results = list(pool.map(one, [(i, f) for i in range(len(candidates)) for f in range(n_folds)]))
    finally:
        marked.unpersist()
    means = [sum(s for i, _, s in results if i == c) / n_folds for c in range(len(candidates))]
    best = max(range(len(candidates)), key=lambda c: (means[c], -c))
    rows = [(i, {k: str(v) for k, v in candidates[i].items()}, f, s) for i, f, s in results]
    return candidates[best], df.sparkSession.createDataFrame(rows, "candidate int, parameters map<string, string>, fold int, score double")
