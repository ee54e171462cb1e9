"""Per-key time series over long tables `(keys, time, value)`: lags, fills, differences, statistics.

All of it runs over range slices (see `plans.scale.ordered`): a key of any length is spread over
tasks, and regressions are solved from sums of products.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators.numeric import chi2_tail, mackinnon_p, solve
from flowspark.plans.scale import around, carry, join_back, lags, ordered, settle


def good(value: str) -> Column:
    """The value, null for NaN."""
    return F.when(~F.isnan(value), F.col(value))


# -- lags, returns ----------------------------------------------------------------------

def lag_matrix(df: DataFrame, keys: Sequence[str], time: str, value: str, max_lag: int, original: bool = True) -> DataFrame:
    """Columns `lag1..lagN` (and the value); rows without all lags are left out."""
    out = lags(ordered(df, keys, [time]), keys, {f"lag{k}": (value, k) for k in range(1, max_lag + 1)})
    out = settle(out.where(F.col("_pos") > max_lag))
    return out if original else out.drop(value)


def autocorrelation(df: DataFrame, keys: Sequence[str], time: str, value: str, max_lag: int) -> DataFrame:
    """`(keys, lag, acf)` with the means of both slices taken separately."""
    names = [f"_l{k}" for k in range(1, max_lag + 1)]
    placed = lags(ordered(df.select(*keys, time, value), keys, [time]), keys, {n: (value, k + 1) for k, n in enumerate(names)})
    aggs = [F.corr(F.when(F.col(n).isNotNull(), F.col(value)), F.col(n)).alias(n) for n in names]
    wide = placed.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k + 1).alias("lag"), F.col(n).alias("acf")) for k, n in enumerate(names)])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.lag", "r.acf")


def quotients(df: DataFrame, keys: Sequence[str], time: str, value: str, k: int = 1, out: str = "quotient") -> DataFrame:
    """Value over the value `k` rows before; over zero as IEEE 754 has it: infinite, or NaN for zero over zero."""
    placed = lags(ordered(df, keys, [time]), keys, {"_b": (value, k)})
    # the power of a zero is infinite with the zero's sign, where a division would be an error
    ratio = F.when(F.col("_b") != 0, F.col(value) / F.col("_b")).otherwise(F.col(value) * F.pow("_b", F.lit(-1.0)))
    return settle(placed.where(F.col("_pos") > k).withColumn(out, ratio)).drop("_b")


def returns(df: DataFrame, keys: Sequence[str], time: str, value: str, k: int = 1, out: str = "ret") -> DataFrame:
    return quotients(df, keys, time, value, k, out).withColumn(out, F.col(out) - 1)


# -- gaps --------------------------------------------------------------------------------

def _ends(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    here = F.when(good(value).isNotNull(), F.col(time))
    return df.groupBy(*keys).agg(F.min(here).alias("_from"), F.max(here).alias("_to"))


def trim(df: DataFrame, keys: Sequence[str], time: str, value: str, leading: bool = True, trailing: bool = True) -> DataFrame:
    """Without the missing values at the start and end of each series."""
    both = join_back(df, _ends(df, keys, time, value), keys)
    cond = F.lit(True)
    if leading:
        cond = cond & (F.col(time) >= F.col("_from"))
    if trailing:
        cond = cond & (F.col(time) <= F.col("_to"))
    return both.where(cond).drop("_from", "_to")


def first_last(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """First and last time with a value."""
    return _ends(df, keys, time, value).withColumnsRenamed({"_from": "first_at", "_to": "last_at"})


def fill_value(df: DataFrame, value: str, filler: float = 0.0) -> DataFrame:
    return df.withColumn(value, F.coalesce(good(value), F.lit(filler)))


def fill(df: DataFrame, keys: Sequence[str], time: str, value: str, how: str) -> DataFrame:
    """previous, next, nearest (a tie goes to the next) or linear (inner gaps only)."""
    placed = ordered(df.withColumn("_v", good(value)), keys, [time])
    placed = placed.withColumn("_at", F.when(F.col("_v").isNotNull(), F.col("_pos")))
    placed = carry(placed, keys, {"_pv": ("_v", "previous"), "_pp": ("_at", "previous"),
                                  "_nv": ("_v", "next"), "_np": ("_at", "next")})
    back, on = F.col("_pos") - F.col("_pp"), F.col("_np") - F.col("_pos")
    if how == "previous":
        filled = F.col("_pv")
    elif how == "next":
        filled = F.col("_nv")
    elif how == "nearest":
        filled = F.when(F.col("_pv").isNull(), F.col("_nv")).when(F.col("_nv").isNull(), F.col("_pv")) \
            .when(back < on, F.col("_pv")).otherwise(F.col("_nv"))
    elif how == "linear":
        slope = (F.col("_nv") - F.col("_pv")) / (F.col("_np") - F.col("_pp"))
        filled = F.when(F.col("_v").isNotNull(), F.col("_v")).otherwise(F.col("_pv") + slope * back)
    else:
        raise ValueError(f"unknown fill {how}")
    return settle(placed.withColumn(value, filled)).drop("_v", "_at", "_pv", "_pp", "_nv", "_np")


# -- resampling, differences ----------------------------------------------------------------

def downsample(df: DataFrame, keys: Sequence[str], time: str, n: int, phase: int = 0) -> DataFrame:
    placed = ordered(df, keys, [time])
    return settle(placed.where(F.pmod(F.col("_pos") - 1 - phase, F.lit(n)) == 0))


def upsample(df: DataFrame, keys: Sequence[str], time: str, value: str, n: int, phase: int = 0, zero: bool = False) -> DataFrame:
    """Every value followed by gaps: `(keys, index, value)` with n rows per old row."""
    placed = ordered(df, keys, [time])
    spread = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    blank = F.lit(0.0) if zero else F.lit(None).cast("double")
    return spread.select(*keys, ((F.col("_pos") - 1) * n + F.col("_o")).alias("index"),
                         F.when(F.col("_o") == phase, F.col(value)).otherwise(blank).alias(value))


def differences(df: DataFrame, keys: Sequence[str], time: str, value: str, k: int = 1) -> DataFrame:
    """v(t) - v(t-k); the first k values stay."""
    placed = lags(ordered(df, keys, [time]), keys, {"_b": (value, k)})
    return settle(placed.withColumn(value, F.when(F.col("_pos") <= k, F.col(value)).otherwise(F.col(value) - F.col("_b")))).drop("_b")


def inverse_differences(df: DataFrame, keys: Sequence[str], time: str, value: str, k: int = 1) -> DataFrame:
    """Running sums per residue class of the place undo `differences`."""
    placed = ordered(df, keys, [time]).withColumn("_cls", F.pmod(F.col("_pos") - 1, F.lit(k)))
    again = placed.drop("_seg", "_n").withColumnRenamed("_pos", "_p0")
    summed = carry(ordered(again, [*keys, "_cls"], ["_p0"]), [*keys, "_cls"], {"_sum": (value, "sum")})
    return settle(summed.withColumn(value, F.col("_sum"))).drop("_sum", "_cls", "_p0")


def differences_of_order(df: DataFrame, keys: Sequence[str], time: str, value: str, d: int) -> DataFrame:
    """d-fold difference: step i leaves the first i values as they are."""
    for i in range(1, d + 1):
        placed = lags(ordered(df, keys, [time]), keys, {"_b": (value, 1)})
        df = settle(placed.withColumn(value, F.when(F.col("_pos") <= i, F.col(value)).otherwise(F.col(value) - F.col("_b")))).drop("_b")
    return df


def inverse_differences_of_order(df: DataFrame, keys: Sequence[str], time: str, value: str, d: int) -> DataFrame:
    for i in range(d, 0, -1):
        placed = ordered(df, keys, [time]).withColumn("_s", F.when(F.col("_pos") >= i, F.col(value)))
        placed = carry(placed, keys, {"_sum": ("_s", "sum")})
        df = settle(placed.withColumn(value, F.when(F.col("_pos") < i, F.col(value)).otherwise(F.col("_sum")))).drop("_s", "_sum")
    return df


def rolling_sum(df: DataFrame, keys: Sequence[str], time: str, value: str, n: int, out: str = "roll_sum") -> DataFrame:
    """Sum of n values ending here; only full windows."""
    placed = around(ordered(df, keys, [time]), keys, n - 1, 0, lambda w: {out: F.sum(value).over(w.rowsBetween(-(n - 1), 0))})
    return settle(placed.where(F.col("_pos") >= n))


# -- least squares per key ------------------------------------------------------------------

def least_squares(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], intercept: bool = True) -> DataFrame:
    """`(keys, n, coefficients, std_errors, ssr, r2)`; coefficients start with the intercept.

    One aggregate collects all sums of products (combined before the shuffle), then each key solves
    a system as small as its number of regressors.
    """
    cols = ["_one", *xs, y] if intercept else [*xs, y]
    full = df.withColumn("_one", F.lit(1.0))
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    full = full.where(complete)
    size = len(cols)
    sums = [F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double")) for i in range(size) for j in range(i, size)]
    moments = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("_m"), F.sum(F.col(y).cast("double")).alias("_y"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema.fields if f.name in keys] + [
        "n long", "coefficients array<double>", "std_errors array<double>", "ssr double", "r2 double"])

    def solve_all(frames):
        import pandas as pd

        for frame in frames:
            rows = [solve(np.array(m), size, int(n), float(total), intercept) for m, n, total in zip(frame["_m"], frame["n"], frame["_y"])]
            out = frame[[*keys, "n"]].copy()
            out["coefficients"] = [r[0] for r in rows]
            out["std_errors"] = [r[1] for r in rows]
            out["ssr"] = pd.Series([r[2] for r in rows], index=out.index, dtype="float64")
            out["r2"] = pd.Series([r[3] for r in rows], index=out.index, dtype="float64")
            yield out

    return moments.mapInPandas(solve_all, schema)


def autoregression(df: DataFrame, keys: Sequence[str], time: str, value: str, p: int, intercept: bool = True) -> DataFrame:
    """AR(p) by least squares: intercept, then the lag coefficients."""
    names = [f"_l{k}" for k in range(1, p + 1)]
    placed = lags(ordered(df.select(*keys, time, value), keys, [time]), keys, {n: (value, k + 1) for k, n in enumerate(names)})
    return least_squares(placed, keys, value, names, intercept)


def autoregression_x(df: DataFrame, keys: Sequence[str], time: str, value: str, xs: Sequence[str], p: int, x_lags: int,
                     same_time: bool = True) -> DataFrame:
    """AR(p) with outside regressors and their lags: intercept, value lags, then x lags, then x."""
    wanted = {f"_l{k}": (value, k) for k in range(1, p + 1)}
    wanted |= {f"_{x}_{k}": (x, k) for x in xs for k in range(1, x_lags + 1)}
    placed = lags(ordered(df.select(*keys, time, value, *xs), keys, [time]), keys, wanted)
    return least_squares(placed, keys, value, [*wanted, *(xs if same_time else [])])


def remove_ar_effects(df: DataFrame, keys: Sequence[str], time: str, value: str, model: DataFrame, p: int) -> DataFrame:
    """Residuals v - c - Σ φ v(t-k); lags before the start count as 0."""
    placed = lags(ordered(df, keys, [time]), keys, {f"_l{k}": (value, k) for k in range(1, p + 1)})
    both = join_back(placed, model.select(*keys, "coefficients"), keys)
    fit = F.get("coefficients", F.lit(0))
    for k in range(1, p + 1):
        fit = fit + F.get("coefficients", F.lit(k)) * F.coalesce(F.col(f"_l{k}"), F.lit(0.0))
    return settle(both.withColumn(value, F.col(value) - fit)).drop("coefficients", *[f"_l{k}" for k in range(1, p + 1)])


# -- tests ------------------------------------------------------------------------------------

def durbin_watson(df: DataFrame, keys: Sequence[str], time: str, residual: str) -> DataFrame:
    placed = lags(ordered(df, keys, [time]), keys, {"_b": (residual, 1)})
    return placed.groupBy(*keys).agg((F.sum(F.pow(F.col(residual) - F.col("_b"), 2)) / F.sum(F.pow(residual, 2))).alias("dw"))


def _with_p(df: DataFrame, statistic: str, degrees: int) -> DataFrame:
    @F.pandas_udf("double")
    def tail(s):
        import pandas as pd

        return pd.Series([chi2_tail(float(x), degrees) for x in s])

    return df.withColumn("p_value", tail(F.col(statistic)))


def ljung_box(df: DataFrame, keys: Sequence[str], time: str, residual: str, max_lag: int) -> DataFrame:
    """n(n+2) Σ r²/(n-k) with its χ² tail."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    acf = join_back(autocorrelation(df, keys, time, residual, max_lag), counts, keys)
    stat = acf.groupBy(*keys).agg((F.first("_n") * (F.first("_n") + 2) * F.sum(F.pow("acf", 2) / (F.col("_n") - F.col("lag")))).alias("statistic"))
    return _with_p(stat, "statistic", max_lag)


def breusch_godfrey(df: DataFrame, keys: Sequence[str], time: str, residual: str, xs: Sequence[str], max_lag: int) -> DataFrame:
    """Serial correlation: n·R² of the residuals on the regressors and their own lags."""
    names = [f"_l{k}" for k in range(1, max_lag + 1)]
    placed = lags(ordered(df, keys, [time]), keys, {n: (residual, k + 1) for k, n in enumerate(names)})
    fit = least_squares(placed, keys, residual, [*xs, *names])
    return _with_p(fit.select(*keys, (F.col("n") * F.col("r2")).alias("statistic")), "statistic", max_lag)


def breusch_pagan(df: DataFrame, keys: Sequence[str], residual: str, xs: Sequence[str]) -> DataFrame:
    """Changing variance: n·R² of the squared residuals on the regressors."""
    squared = df.withColumn("_sq", F.pow(residual, 2))
    fit = least_squares(squared, keys, "_sq", xs)
    return _with_p(fit.select(*keys, (F.col("n") * F.col("r2")).alias("statistic")), "statistic", len(xs))


def adf_test(df: DataFrame, keys: Sequence[str], time: str, value: str, max_lag: int, regression: str = "c") -> DataFrame:
    """Augmented Dickey-Fuller statistic and its approximate p-value; regression nc, c, ct or ctt (quadratic trend)."""
    wanted = {f"_l{k}": (value, k) for k in range(1, max_lag + 2)}
    placed = lags(ordered(df.select(*keys, time, value), keys, [time]), keys, wanted)
    placed = placed.withColumn("_d", F.col(value) - F.col("_l1"))
    for k in range(1, max_lag + 1):
        placed = placed.withColumn(f"_d{k}", F.col(f"_l{k}") - F.col(f"_l{k + 1}"))
    xs = ["_l1", *[f"_d{k}" for k in range(1, max_lag + 1)]]
    if regression in ("ct", "ctt"):
        placed = placed.withColumn("_trend", F.col("_pos").cast("double"))
        xs.append("_trend")
    if regression == "ctt":
        # centred, so that the sums of its powers stay well conditioned
        placed = placed.withColumn("_bend", F.pow((F.col("_pos") - (F.col("_n") + 1) / 2) / F.col("_n"), 2))
        xs.append("_bend")
    fit = least_squares(placed, keys, "_d", xs, intercept=regression != "nc")
    at = 0 if regression == "nc" else 1
    stat = fit.select(*keys, (F.get("coefficients", F.lit(at)) / F.get("std_errors", F.lit(at))).alias("statistic"))

    @F.pandas_udf("double")
    def p_of(s):
        import pandas as pd

        return pd.Series([mackinnon_p(float(x), regression) for x in s])

    return stat.withColumn("p_value", p_of("statistic"))


def kpss_test(df: DataFrame, keys: Sequence[str], time: str, value: str, max_lag: int | None = None, regression: str = "c") -> DataFrame:
    """KPSS statistic: squared partial sums of the residuals over the long-run variance.

    The Newey-West lag is 3√n/13 of the longest series unless it is given; shorter series use
    their own lag.
    """
    placed = ordered(df.select(*keys, time, value), keys, [time])
    placed = placed.withColumn("_trend", F.col("_pos").cast("double"))
    fit = least_squares(placed, keys, value, ["_trend"] if regression == "ct" else [])
    both = join_back(placed, fit.select(*keys, "coefficients"), keys)
    level = F.get("coefficients", F.lit(0))
    if regression == "ct":
        level = level + F.get("coefficients", F.lit(1)) * F.col("_trend")
    resid = both.withColumn("_e", F.col(value) - level).drop("coefficients", "_trend")
    resid = carry(resid, keys, {"_s": ("_e", "sum")})
    if max_lag is None:
        longest = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0
        own = F.floor(3 * F.sqrt(F.col("_n").cast("double")) / 13).cast("long")
        top = int(3 * math.sqrt(longest) / 13)
    else:
        own, top = F.lit(max_lag).cast("long"), max_lag
    names = {f"_e{k}": ("_e", k) for k in range(1, top + 1)}
    placed = lags(resid, keys, names) if names else resid
    variance = F.sum(F.pow("_e", 2))
    for k in range(1, top + 1):
        weight = F.when(own >= k, 1 - F.lit(float(k)) / (own + 1)).otherwise(0.0)
        variance = variance + 2 * F.sum(weight * F.col("_e") * F.coalesce(F.col(f"_e{k}"), F.lit(0.0)))
    n = F.max("_n").cast("double")
    return placed.groupBy(*keys).agg((F.sum(F.pow("_s", 2)) / (n * n) / (variance / n)).alias("statistic"))


# Published critical values at 10, 5, 2.5 and 1 percent.
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
