"""Seasonal ARIMA forecasts of many series: each series is fitted and filtered by itself, groups of series in parallel.

A series is differenced (once for ``d``, at the season's distance for ``D``); what is left is an ARMA process whose polynomials are the
products of the plain and the seasonal ones. Its likelihood comes from a Kalman filter in Harvey's form (a state of as many
numbers as the longer polynomial), started from the stationary law; the variance is eliminated and the coefficients are
found by a simplex search over partial correlations, so every point searched is stationary and invertible. A forecast is
one step ahead; each value then updates the state, as in a stream.

A group holds one series, whose length is its number of periods. The module travels with its functions.
"""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def from_partial(r: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from its partial correlations (each between -1 and 1)."""
    out = np.zeros(0)
    for k in r:
        out = np.append(out - k * out[::-1], k)
    return out


def product(plain: np.ndarray, seasonal: np.ndarray, season: int) -> np.ndarray:
    """Coefficients (without the leading 1) of (1 + plain(B)) (1 + seasonal(B^season))."""
    long = np.zeros(1 + season * len(seasonal))
    long[0] = 1
    long[season::season] = seasonal
    return np.convolve(np.append(1.0, plain), long)[1:]


def coefficients(z: np.ndarray, orders: tuple[int, int, int, int], season: int) -> tuple[np.ndarray, np.ndarray]:
    """Autoregressive and moving-average coefficients of the product polynomials from free numbers ``z``."""
    p, q, P, Q = orders
    parts = np.split(np.tanh(z), np.cumsum([p, q, P]))
    phi, theta, sphi, stheta = (from_partial(r) for r in parts)
    return -product(-phi, -sphi, season), product(-theta, -stheta, season)


class Filter:
    """Kalman filter of an ARMA process: state, its covariance over that of the shocks, and the shape of its steps."""

    def __init__(self, phi: np.ndarray, theta: np.ndarray):
        r = max(len(phi), len(theta) + 1, 1)
        self.phi, self.load = np.zeros(r), np.zeros(r)
        self.phi[: len(phi)] = phi
        self.load[0], self.load[1 : 1 + len(theta)] = 1, theta
        self.move = np.zeros((r, r))
        self.move[:, 0] = self.phi
        self.move[np.arange(r - 1), np.arange(1, r)] = 1
        self.shock = np.outer(self.load, self.load)
        a, total = self.move, self.shock
        for _ in range(60):  # sums move^k shock move'^k by doubling
            more = a @ total @ a.T
            total, a = total + more, a @ a
            if np.abs(more).max() <= 1e-14 * np.abs(total).max():
                break
        self.state, self.cov, self.steady = np.zeros(r), total, False

    def step(self, value: float) -> tuple[float, float]:
        """Error and its variance (over that of the shocks) of the forecast of ``value``, which then updates the state. A missing value only moves it on."""
        shape, guess = self.cov[0, 0], self.state[0]
        if value is None or not math.isfinite(value):
            self.state, self.steady = self.move @ self.state, False
            self.cov = self.move @ self.cov @ self.move.T + self.shock
            return math.nan, shape
        error = value - guess
        if not self.steady:
            column = self.cov[:, 0]
            self.gain = self.move @ column / shape
            after = self.move @ (self.cov - np.outer(column, column) / shape) @ self.move.T + self.shock
            self.steady = np.abs(after - self.cov).max() < 1e-12 * max(1.0, shape)
            self.cov = after
        self.state = self.move @ self.state + self.gain * error
        return error, shape

    def forecast(self) -> float:
        return float(self.state[0])


def deviance(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> float:
    """Minus twice the log-likelihood at the best variance, up to a constant; infinite where it can't be computed."""
    f, squares, logs, n = Filter(phi, theta), 0.0, 0.0, 0
    for x in w:
        error, shape = f.step(x)
        if not error == error:
            continue
        squares += error * error / shape
        logs += math.log(shape)
        n += 1
    return n * math.log(max(squares, 1e-300) / n) + logs if n else 0.0


def simplex(f, start: np.ndarray, steps: int, size: float = 0.5) -> np.ndarray:
    """The least point that a Nelder-Mead search finds in ``steps`` values of ``f``."""
    n = len(start)
    if not n:
        return start
    points = [start, *(start + size * np.eye(n)[i] for i in range(n))]
    known = [f(p) for p in points]
    used = n + 1
    while used < steps:
        order = np.argsort(known, kind="stable")
        points, known = [points[i] for i in order], [known[i] for i in order]
        if known[-1] - known[0] < 1e-8 * (1 + abs(known[0])):
            break
        middle = np.mean(points[:-1], axis=0)
        out = middle + (middle - points[-1])
        value = f(out)
        used += 1
        if value < known[0]:
            far = middle + 2 * (middle - points[-1])
            beyond = f(far)
            used += 1
            points[-1], known[-1] = (far, beyond) if beyond < value else (out, value)
        elif value < known[-2]:
            points[-1], known[-1] = out, value
        else:
            inner = middle + 0.5 * ((out if value < known[-1] else points[-1]) - middle)
            nearer = f(inner)
            used += 1
            if nearer < min(value, known[-1]):
                points[-1], known[-1] = inner, nearer
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                known = [known[0], *(f(p) for p in points[1:])]
                used += n
    return points[int(np.argmin(known))]


def difference(y: np.ndarray, d: int, D: int, season: int) -> np.ndarray:
    for _ in range(D):
        y = y[season:] - y[:-season]
    for _ in range(d):
        y = y[1:] - y[:-1]
    return y


def one_step(y: np.ndarray, learn: int, order: tuple[int, int, int], seasonal: tuple[int, int, int, int], steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts of ``y[learn:]``, each from all values before it, and the free numbers fitted to ``y[:learn]``."""
    (p, d, q), (P, D, Q, season) = order, seasonal
    orders, w = (p, q, P, Q), difference(y, d, D, season)
    lost = len(y) - len(w)
    train = w[: max(0, learn - lost)]
    z = simplex(lambda v: deviance(train, *coefficients(v, orders, season)), np.zeros(sum(orders)), steps) if len(train) > sum(orders) + 1 else np.zeros(sum(orders))
    f = Filter(*coefficients(z, orders, season))
    ahead = np.full(len(y), np.nan)
    for t in range(lost, len(y)):
        # The differences of y[t] are those of its past plus y[t]: with y[t] put to 0 they are what must be added.
        past = difference(np.append(y[t - lost : t], 0.0), d, D, season)[-1] if lost else 0.0
        ahead[t] = f.forecast() - past
        f.step(w[t - lost])
    return ahead[learn:], z


def seasonal_forecasts(df: DataFrame, series: str, time: str, value: str, order: tuple[int, int, int] = (1, 1, 1), seasonal: tuple[int, int, int, int] = (1, 1, 1, 12), train: float = 0.8, steps: int = 200) -> DataFrame:
    """(series, time, value, forecast) of the last part of each series: one-step forecasts, learnt from its first ``train`` share.

    One row a series and period, in the order of ``time``. Series are dealt by key, each fitted where it lies. A value that is null is
    passed over and still forecast; a forecast that lacks a past (a series shorter than the differences) is null.
    """
    import pyarrow as pa

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("t", "ascending")])
        y = rows["v"].to_numpy().astype(np.float64)
        learn = int(len(y) * train)
        ahead, _ = one_step(y, learn, order, seasonal, steps)
        return pa.table([rows["s"].slice(learn), rows["t"].slice(learn), rows["v"].slice(learn), pa.array(ahead, pa.float64(), from_pandas=True)], names=["s", "t", "v", "forecast"])

    rows = df.select(F.col(series).alias("s"), F.col(time).alias("t"), F.col(value).cast("double").alias("v"))
    out = rows.groupBy("s").applyInArrow(run, f"s {kinds[series]}, t {kinds[time]}, v double, forecast double")
    return out.select(F.col("s").alias(series), F.col("t").alias(time), F.col("v").alias(value), "forecast")
