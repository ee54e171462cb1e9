"""Models that walk a series step by step, one key per group: exponential smoothing, GARCH, ARIMA, splines.

The data is averaged per time slot first (`slots`), so a series is as long as its calendar and not
as its data; `guard` checks that before a group is handed to Python.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.numeric import bounded_simplex
from flowspark.plans.scale import ordered, settle

MAX_POINTS = 2_000_000


def slots(df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], grain: str) -> DataFrame:
    """One row per key and time slot with the mean values."""
    ts = F.date_trunc(grain, F.col(time).cast("timestamp"))
    return df.groupBy(*keys, ts.alias(time)).agg(*[F.avg(v).alias(v) for v in values])


def stack(df: DataFrame, keys: Sequence[str], time: str, fields: Sequence[str]) -> DataFrame:
    """Long form `(keys, field, time, value)`."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])
    return df.select(*keys, time, F.explode(rows).alias("_r")).select(*keys, F.col("_r.field").alias("field"), time,
                                                                     F.col("_r.value").alias("value"))


def guard(df: DataFrame, keys: Sequence[str], limit: int = MAX_POINTS) -> DataFrame:
    """Refuse series that are too long for one group; a coarser grain makes them shorter."""
    longest = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0
    if longest > limit:
        raise ValueError(f"a series has {longest} points, more than {limit}; use a coarser time grain")
    return df


def per_series(df: DataFrame, keys: Sequence[str], time: str, value: str, fit: Callable, schema: str) -> DataFrame:
    """Run `fit(times, values) -> dict of columns` on every key's series in time order."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = list(keys)

    def job(frame):
        import pandas as pd

        frame = frame.sort_values(time)
        out = pd.DataFrame(fit(frame[time].to_numpy(), frame[value].to_numpy(dtype=float)))
        for at, k in enumerate(names):
            out.insert(at, k, frame[k].iloc[0])
        return out

    return guard(df, keys).groupBy(*keys).applyInPandas(job, f"{kinds}, {schema}" if kinds else schema)


# -- splines -------------------------------------------------------------------------------

def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (x, y), read at points inside [x0, xn]."""
    n = len(x)
    if n == 1:
        return np.full(len(at), y[0])
    h = np.diff(x).astype(float)
    slope = np.diff(y) / h
    second = np.zeros(n)
    if n > 2:
        lower, diag, upper = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
        right = 6 * np.diff(slope)
        for i in range(1, n - 2):
            w = lower[i] / diag[i - 1]
            diag[i] -= w * upper[i - 1]
            right[i] -= w * right[i - 1]
        inner = np.zeros(n - 2)
        for i in range(n - 3, -1, -1):
            inner[i] = (right[i] - (upper[i] * inner[i + 1] if i < n - 3 else 0)) / diag[i]
        second[1:-1] = inner
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, u = at - x[i], x[i + 1] - at
    return (second[i] * u ** 3 + second[i + 1] * t ** 3) / (6 * h[i]) + (y[i] / h[i] - second[i] * h[i] / 6) * u \
        + (y[i + 1] / h[i] - second[i + 1] * h[i] / 6) * t


def fill_spline(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Gaps between the first and last value filled by a natural cubic spline over the places."""

    def fit(times, values):
        known = np.flatnonzero(~np.isnan(values))
        filled = values.copy()
        if len(known):
            span = np.arange(known[0], known[-1] + 1)
            filled[span] = natural_spline(known.astype(float), values[known], span.astype(float))
        return {time: times, value: filled}

    kind = df.schema[time].dataType.simpleString()
    return per_series(df, keys, time, value, fit, f"`{time}` {kind}, `{value}` double")


# -- exponential smoothing ---------------------------------------------------------------------

def ewma_smooth(values: Sequence[float], a: float) -> list[float]:
    out, level = [], None
    for v in values:
        level = v if level is None else a * v + (1 - a) * level
        out.append(level)
    return out


def ewma_restore(smoothed: Sequence[float], a: float) -> list[float]:
    return [s if i == 0 else (s - (1 - a) * smoothed[i - 1]) / a for i, s in enumerate(smoothed)]


def ewma_fit(values: np.ndarray) -> float:
    """Smoothing in (0, 1] with the least one-step squared error."""
    data = [float(v) for v in values]

    def sse(a):
        smooth = ewma_smooth(data, a)
        return sum((data[i + 1] - smooth[i]) ** 2 for i in range(len(data) - 1))

    best, _ = bounded_simplex(lambda p: sse(p[0]), [0.94], [1e-4], [1.0], steps=200)
    return float(best[0])


class HoltWinters:
    """Level, trend and season with weights alpha, beta, gamma."""

    def __init__(self, period: int, additive: bool = True, weights=(0.3, 0.1, 0.1)):
        self.period, self.additive, self.weights = period, additive, tuple(float(w) for w in weights)

    def start(self, y: Sequence[float]):
        """Initial state by classical decomposition of the first two periods: the line through the centred moving
        average gives level and trend, the mean deviation from that average per phase the season."""
        p = self.period
        half = p // 2
        weights = np.full(2 * half + 1, 1 / p)
        if p % 2 == 0:
            weights[[0, -1]] /= 2
        head = np.asarray(y[:2 * p], dtype=float)
        places = np.arange(half, len(head) - half)
        average = np.array([weights @ head[i - half:i + half + 1] for i in places])
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = head[places] - average if self.additive else head[places] / average
        neutral = 0.0 if self.additive else 1.0
        phases = [apart[(places % p == k) & np.isfinite(apart)] for k in range(p)]
        season = np.array([own.mean() if len(own) else neutral for own in phases])
        season = season - season.mean() if self.additive else season / season.mean()
        trend, level = np.polyfit(np.arange(1, len(average) + 1), average, 1) if len(average) > 1 else (0.0, average.mean())
        return float(level), float(trend), [float(v) for v in season]

    def run(self, y: Sequence[float], weights=None, begin=None):
        """(squared error from index `period` on, level, trend, last season)."""
        alpha, beta, gamma = weights if weights is not None else self.weights
        level, trend, season = begin or self.start(y)
        season = list(season)
        p, error = self.period, 0.0
        for i in range(p, len(y)):
            s = season[i % p]
            guess = level + trend + s if self.additive else (level + trend) * s
            error += (y[i] - guess) ** 2
            before = level
            level = alpha * (y[i] - s if self.additive else y[i] / s) + (1 - alpha) * (level + trend)
            trend = beta * (level - before) + (1 - beta) * trend
            season[i % p] = gamma * (y[i] - level if self.additive else y[i] / level) + (1 - gamma) * s
        return error, level, trend, season

    def fit(self, y: np.ndarray) -> HoltWinters:
        data = [float(v) for v in y]
        begin = self.start(data)

        def error(w):
            try:
                return self.run(data, tuple(w), begin)[0]
            except (ZeroDivisionError, OverflowError):
                return math.inf

        best = None
        for start in ([0.3, 0.1, 0.1], [0.7, 0.05, 0.7], [0.1, 0.01, 0.3]):
            found = bounded_simplex(error, start, [0, 0, 0], [1, 1, 1])
            if best is None or found[1] < best[1]:
                best = found
        self.weights = tuple(float(w) for w in best[0])
        return self

    def forecast(self, y: np.ndarray, n: int) -> list[float]:
        data = [float(v) for v in y]
        _, level, trend, season = self.run(data)
        out = []
        for i in range(n):
            s = season[(len(data) + i) % self.period]
            out.append(level + (i + 1) * trend + s if self.additive else (level + (i + 1) * trend) * s)
        return out


# -- changing variance ------------------------------------------------------------------------------

def garch_likelihood(y: Sequence[float], omega: float, alpha: float, beta: float) -> float:
    h, total = omega / (1 - alpha - beta), 0.0
    for i in range(1, len(y)):
        h = omega + alpha * y[i - 1] ** 2 + beta * h
        total -= 0.5 * math.log(h) + 0.5 * y[i] ** 2 / h
    return total - 0.5 * math.log(2 * math.pi) * (len(y) - 1)


def garch_fit(y: np.ndarray) -> tuple[float, float, float]:
    data = [float(v) for v in y]
    spread = max(float(np.var(y)), 1e-12)

    def cost(p):
        omega, alpha, beta = p
        if omega <= 0 or alpha + beta >= 0.9999:
            return math.inf
        return -garch_likelihood(data, omega, alpha, beta)

    best = None
    for start in ([0.2 * spread, 0.2, 0.2], [0.1 * spread, 0.1, 0.8], [0.5 * spread, 0.3, 0.1]):
        found = bounded_simplex(cost, start, [1e-12, 0, 0], [10 * spread, 1, 1], steps=600)
        if best is None or found[1] < best[1]:
            best = found
    return tuple(float(v) for v in best[0])


def garch_standardize(y: Sequence[float], omega: float, alpha: float, beta: float) -> list[float]:
    h, out = omega / (1 - alpha - beta), []
    for i, v in enumerate(y):
        if i:
            h = omega + alpha * y[i - 1] ** 2 + beta * h
        out.append(v / math.sqrt(h))
    return out


def garch_apply(z: Sequence[float], omega: float, alpha: float, beta: float) -> list[float]:
    h, out = omega / (1 - alpha - beta), []
    for i, v in enumerate(z):
        if i:
            h = omega + alpha * out[-1] ** 2 + beta * h
        out.append(v * math.sqrt(h))
    return out


def ar_garch_fit(y: np.ndarray) -> dict:
    x = np.c_[np.ones(len(y) - 1), y[:-1]]
    c, phi = np.linalg.lstsq(x, y[1:], rcond=None)[0]
    residual = y - c - phi * np.r_[0.0, y[:-1]]
    omega, alpha, beta = garch_fit(residual)
    return {"c": float(c), "phi": float(phi), "omega": omega, "alpha": alpha, "beta": beta}


# -- ARIMA -----------------------------------------------------------------------------------------

def _lagged(y: np.ndarray, k: int, start: int) -> np.ndarray:
    return np.column_stack([y[start - i:len(y) - i] for i in range(1, k + 1)]) if k else np.empty((len(y) - start, 0))


def kpss_level(y: np.ndarray) -> float:
    e = y - y.mean()
    n, lag = len(y), int(3 * math.sqrt(len(y)) / 13)
    variance = (e ** 2).sum() + sum(2 * (1 - k / (lag + 1)) * (e[k:] * e[:-k]).sum() for k in range(1, lag + 1))
    return float((np.cumsum(e) ** 2).sum() / n ** 2 / max(variance / n, 1e-300))


class Arima:
    """ARMA on the d-fold differences, with optional outside regressors."""

    def __init__(self, p: int, d: int, q: int):
        self.p, self.d, self.q = p, d, q
        self.params = np.zeros(1 + p + q)

    def residuals(self, y: np.ndarray, x: np.ndarray | None, params: np.ndarray) -> np.ndarray:
        p, q = self.p, self.q
        c, ar, ma, bx = params[0], params[1:1 + p], params[1 + p:1 + p + q], params[1 + p + q:]
        base = y - c - (x @ bx if x is not None and len(bx) else 0.0)
        if p:
            base = base.copy()
            for i in range(1, p + 1):
                base[i:] -= ar[i - 1] * y[:-i]
            base[:p] = 0.0
        if not q:
            return base
        out = [0.0] * len(y)
        weights = [float(m) for m in ma]
        for t in range(p, len(y)):
            e = float(base[t])
            for i in range(q):
                if t - 1 - i >= 0:
                    e -= weights[i] * out[t - 1 - i]
            out[t] = e
        return np.array(out)

    def fit(self, series: np.ndarray, x: np.ndarray | None = None, refine: int = 15) -> Arima:
        y = np.diff(series, self.d) if self.d else np.asarray(series, float)
        x = None if x is None else np.asarray(x, float)[self.d:]
        p, q = self.p, self.q
        long = min(max(p, q) + 5, max(1, len(y) // 3))
        if q:  # innovations from a long autoregression
            start = long
            design = np.c_[np.ones(len(y) - start), _lagged(y, long, start)]
            innovations = np.r_[np.zeros(start), y[start:] - design @ np.linalg.lstsq(design, y[start:], rcond=None)[0]]
            start = long + q
        else:
            innovations, start = np.zeros(len(y)), p
        design = np.c_[np.ones(len(y) - start), _lagged(y, p, start), _lagged(innovations, q, start)]
        if x is not None:
            design = np.c_[design, x[start:]]
        params = np.linalg.lstsq(design, y[start:], rcond=None)[0]
        best = float((self.residuals(y, x, params) ** 2).sum())
        if q:  # Gauss-Newton on the conditional sum of squares
            for _ in range(refine):
                e = self.residuals(y, x, params)
                jacobian = np.column_stack([(self.residuals(y, x, params + step) - e) / 1e-6 for step in np.eye(len(params)) * 1e-6])
                move = np.linalg.lstsq(jacobian, -e, rcond=None)[0]
                scale = 1.0
                while scale > 1e-3:
                    cost = float((self.residuals(y, x, params + scale * move) ** 2).sum())
                    if np.isfinite(cost) and cost < best:
                        break
                    scale /= 2
                else:
                    break
                gain, best, params = best - cost, cost, params + scale * move
                if gain <= 1e-10 * (abs(best) + 1e-10):
                    break
        self.params, self.sse, self.n = params, best, len(y) - p
        return self

    def aic(self) -> float:
        return self.n * math.log(max(self.sse / max(self.n, 1), 1e-300)) + 2 * (1 + self.p + self.q)

    def forecast(self, series: np.ndarray, n: int, x: np.ndarray | None = None, future_x: np.ndarray | None = None) -> list[float]:
        levels = [np.asarray(series, float)]
        for _ in range(self.d):
            levels.append(np.diff(levels[-1]))
        y = levels[-1]
        past_x = None if x is None else np.asarray(x, float)[self.d:]
        e = list(self.residuals(y, past_x, self.params))
        values = list(y)
        p, q = self.p, self.q
        c, ar, ma, bx = self.params[0], self.params[1:1 + p], self.params[1 + p:1 + p + q], self.params[1 + p + q:]
        out = []
        for t in range(n):
            v = c + sum(ar[i] * values[-1 - i] for i in range(p)) + sum(ma[i] * e[-1 - i] for i in range(q) if len(e) > i)
            if future_x is not None and len(bx):
                v += float(np.asarray(future_x, float)[t] @ bx)
            values.append(v)
            e.append(0.0)
            out.append(v)
        for level in reversed(levels[:-1]):
            out = list(level[-1] + np.cumsum(out))
        return [float(v) for v in out]


def auto_arima(series: np.ndarray, max_p: int = 5, max_d: int = 2, max_q: int = 5) -> Arima:
    """d until the level test is passed, then (p, q) with the least AIC."""
    d = 0
    while d < max_d and len(series) > d + 10 and kpss_level(np.diff(series, d) if d else series) > 0.463:
        d += 1
    best = None
    for p in range(max_p + 1):
        for q in range(max_q + 1):
            if p + q == 0 or len(series) - d < 3 * (p + q + 2) + 5:
                continue
            try:
                tried = Arima(p, d, q).fit(series, refine=4)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(tried.aic()) and (best is None or tried.aic() < best.aic()):
                best = tried
    return (best or Arima(0, d, 0)).fit(series)


# -- jobs --------------------------------------------------------------------------------------------

def train(values: np.ndarray, kind: str, period: int = 12, additive: bool = True) -> dict:
    """A model as plain numbers."""
    values = np.nan_to_num(values)
    if kind == "holt-winters" and len(values) >= 2 * period:
        hw = HoltWinters(period, additive).fit(values)
        return {"kind": kind, "period": period, "additive": additive, "weights": hw.weights}
    if len(values) < 3:
        return {"kind": "mean"}
    fitted = auto_arima(values)
    return {"kind": "arima", "order": [fitted.p, fitted.d, fitted.q], "params": [float(v) for v in fitted.params]}


def predict(model: dict, values: np.ndarray, n: int) -> list[float]:
    values = np.nan_to_num(values)
    if model["kind"] == "holt-winters":
        return HoltWinters(model["period"], model["additive"], model["weights"]).forecast(values, n)
    if model["kind"] == "mean":
        return [float(values.mean())] * n
    arima = Arima(*model["order"])
    arima.params = np.array(model["params"])
    return arima.forecast(values, n)


def forecast(df: DataFrame, keys: Sequence[str], time: str, fields: Sequence[str], seconds: int, kind: str = "holt-winters",
             period: int = 12, additive: bool = True, models: DataFrame | None = None) -> DataFrame:
    """Future rows `(keys, field, time, value)`; the step is the distance of the first two times.

    `models` may hold rows `(keys, field, model)`, model being JSON; series without one are fitted.
    """
    long = stack(df, keys, time, fields).withColumn(time, F.col(time).cast("timestamp"))
    by = [*keys, "field"]
    if models is not None:
        long = long.join(models.select(*by, "model"), by, "left")
    else:
        long = long.withColumn("model", F.lit(None).cast("string"))
    kinds = ", ".join(f"`{k}` {long.schema[k].dataType.simpleString()}" for k in by)

    def job(frame):
        import pandas as pd

        frame = frame.sort_values(time)
        values, times = frame["value"].to_numpy(dtype=float), frame[time].to_numpy()
        head = {k: frame[k].iloc[0] for k in by}
        if len(values) < 2:
            return pd.DataFrame({**{k: pd.Series([], dtype=object) for k in by}, time: pd.Series([], dtype="datetime64[ns]"),
                                 "value": pd.Series([], dtype="float64")})
        step = times[1] - times[0]
        n = int(seconds // max(step / np.timedelta64(1, "s"), 1e-9))
        stored = frame["model"].iloc[0]
        model = json.loads(stored) if isinstance(stored, str) else train(values, kind, period, additive)
        out = pd.DataFrame({time: pd.Series([times[-1] + step * (i + 1) for i in range(n)], dtype="datetime64[ns]"),
                            "value": pd.Series(predict(model, values, n), dtype="float64")})
        for at, (k, v) in enumerate(head.items()):
            out.insert(at, k, v)
        return out

    return guard(long, by).groupBy(*by).applyInPandas(job, f"{kinds}, `{time}` timestamp, value double")


def backtest(df: DataFrame, keys: Sequence[str], time: str, fields: Sequence[str], kind: str = "holt-winters",
             period: int = 12, additive: bool = True) -> DataFrame:
    """Train on the first half of each series, forecast the second: `(keys, field, time, actual,
    predicted, model)`."""
    long = stack(df, keys, time, fields).withColumn(time, F.col(time).cast("timestamp"))
    by = [*keys, "field"]
    placed = ordered(long, by, [time])
    halves = settle(placed.withColumn("_train", F.col("_pos") - 1 <= F.floor(F.col("_n") / 2)))
    kinds = ", ".join(f"`{k}` {long.schema[k].dataType.simpleString()}" for k in by)

    def job(frame):
        import pandas as pd

        frame = frame.sort_values(time)
        first, rest = frame[frame["_train"]], frame[~frame["_train"]]
        values = first["value"].to_numpy(dtype=float)
        model = train(values, kind, period, additive)
        out = pd.DataFrame({time: rest[time].to_numpy(), "actual": rest["value"].to_numpy(dtype=float),
                            "predicted": predict(model, values, len(rest)), "model": json.dumps(model)})
        for at, k in enumerate(by):
            out.insert(at, k, frame[k].iloc[0])
        return out

    return guard(halves, by).groupBy(*by).applyInPandas(job, f"{kinds}, `{time}` timestamp, actual double, predicted double, model string")


def model_rows(tested: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Model rows with their backtest error, ready to be stored."""
    by = [*keys, "field", "model"]
    return tested.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2))).alias("rmse"))
