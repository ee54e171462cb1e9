"""Small numeric helpers for workers: solving normal equations, tails, a bounded simplex search."""

from __future__ import annotations

import math

import numpy as np


def solve(moments: np.ndarray, size: int, n: int, y_sum: float, intercept: bool):
    """Coefficients, standard errors, residual sum and R² from the upper triangle of [X y]ᵀ[X y]."""
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = moments
    full = full + np.triu(full, 1).T
    xx, xy, yy = full[:-1, :-1], full[:-1, -1], full[-1, -1]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    ssr = max(float(yy - beta @ xy), 0.0)
    dof = n - (size - 1)
    errors = np.sqrt(np.clip(np.diag(inverse) * ssr / dof, 0, None)) if dof > 0 else np.full(size - 1, np.nan)
    spread = yy - y_sum * y_sum / n if intercept else yy
    r2 = 1 - ssr / spread if spread > 0 else 0.0
    return beta.tolist(), errors.tolist(), ssr, float(r2)


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return min(1.0, front * h)


def chi2_tail(x: float, degrees: int) -> float:
    return gamma_tail(degrees / 2, x / 2)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


# Response surface coefficients published by MacKinnon (1994) for one series.
MACKINNON_MAX = {"nc": math.inf, "c": 2.74, "ct": 0.7, "ctt": 0.54}
MACKINNON_MIN = {"nc": -19.04, "c": -18.83, "ct": -16.18, "ctt": -17.17}
MACKINNON_STAR = {"nc": -1.04, "c": -1.61, "ct": -2.89, "ctt": -3.21}
MACKINNON_SMALL = {"nc": (0.6344, 1.2378, 0.032496), "c": (2.1659, 1.4412, 0.038269), "ct": (3.2512, 1.6047, 0.049588),
                   "ctt": (4.0003, 1.658, 0.048288)}
MACKINNON_LARGE = {"nc": (0.4797, 0.93557, -0.06999, 0.033066), "c": (1.7339, 0.93202, -0.12745, -0.010368),
                   "ct": (2.5261, 0.61654, -0.37956, -0.060285), "ctt": (3.0778, 0.49529, -0.41477, -0.059359)}


def mackinnon_p(t: float, regression: str) -> float:
    """Approximate p-value of a unit-root statistic."""
    if t > MACKINNON_MAX[regression]:
        return 1.0
    if t < MACKINNON_MIN[regression]:
        return 0.0
    table = MACKINNON_SMALL if t <= MACKINNON_STAR[regression] else MACKINNON_LARGE
    return normal_cdf(sum(c * t ** i for i, c in enumerate(table[regression])))


def bounded_simplex(f, start, low, high, steps: int = 400, tol: float = 1e-10):
    """Smallest value of f over a box by a simplex search; points outside are moved to the edge."""
    low, high = np.asarray(low, float), np.asarray(high, float)

    def at(x):
        x = np.clip(x, low, high)
        v = f(x)
        return (v if np.isfinite(v) else 1e300), x

    start = np.clip(np.asarray(start, float), low, high)
    points = [at(start)]
    for i in range(len(start)):
        move = start.copy()
        step = 0.2 * (high[i] - low[i]) if np.isfinite(high[i] - low[i]) else 0.2 * max(abs(start[i]), 1.0)
        move[i] = move[i] + step if move[i] + step <= high[i] else move[i] - step
        points.append(at(move))
    for _ in range(steps):
        points.sort(key=lambda p: p[0])
        if abs(points[-1][0] - points[0][0]) <= tol * (abs(points[0][0]) + tol):
            break
        centre = np.mean([p[1] for p in points[:-1]], axis=0)
        worst = points[-1][1]
        mirrored = at(centre + (centre - worst))
        if mirrored[0] < points[0][0]:
            far = at(centre + 2 * (centre - worst))
            points[-1] = far if far[0] < mirrored[0] else mirrored
        elif mirrored[0] < points[-2][0]:
            points[-1] = mirrored
        else:
            near = at(centre + 0.5 * ((mirrored[1] if mirrored[0] < points[-1][0] else worst) - centre))
            if near[0] < min(mirrored[0], points[-1][0]):
                points[-1] = near
            else:
                best = points[0][1]
                points = [points[0]] + [at(best + 0.5 * (p[1] - best)) for p in points[1:]]
    points.sort(key=lambda p: p[0])
    return points[0][1], points[0][0]
