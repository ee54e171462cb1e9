import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from flowspark.operators import forecast as FC
from flowspark.operators import numeric, series

# Monthly airline passengers 1949 to 1960, a public data set.
PASSENGERS = [
    112, 118, 132, 129, 121, 135, 148, 148, 136, 119, 104, 118, 115, 126, 141, 135, 125, 149, 170, 170, 158, 133, 114, 140,
    145, 150, 178, 163, 172, 178, 199, 199, 184, 162, 146, 166, 171, 180, 193, 181, 183, 218, 230, 242, 209, 191, 172, 194,
    196, 196, 236, 235, 229, 243, 264, 272, 237, 211, 180, 201, 204, 188, 235, 227, 234, 264, 302, 293, 259, 229, 203, 229,
    242, 233, 267, 269, 270, 315, 364, 347, 312, 274, 237, 278, 284, 277, 317, 313, 318, 374, 413, 405, 355, 306, 271, 306,
    315, 301, 356, 348, 355, 422, 465, 467, 404, 347, 305, 336, 340, 318, 362, 348, 363, 435, 491, 505, 404, 359, 310, 337,
    360, 342, 406, 396, 420, 472, 548, 559, 463, 407, 362, 405, 417, 391, 419, 461, 472, 535, 622, 606, 508, 461, 390, 432]


def frame(spark, values, key="k"):
    rows = [(key, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, t int, v double")


def column(df, name="v"):
    return [r[name] for r in df.orderBy("t").collect()]


def test_quotients_over_zero(spark):
    got = column(series.quotients(frame(spark, [0.0, -0.0, 0.0, 2.0, -1.0, None, 4.0]), ["key"], "t", "v"), "quotient")
    assert all(math.isnan(x) for x in got[:2]) and got[2:4] == [math.inf, -0.5] and got[4:] == [None, None]
    got = column(series.returns(frame(spark, [0.0, -3.0, -0.0, -3.0, 6.0]), ["key"], "t", "v"), "ret")
    assert got == [-math.inf, -1.0, math.inf, -3.0]


def test_fills(spark):
    nan = float("nan")
    df = frame(spark, [nan, 1, nan, nan, nan, 5, nan])
    assert column(series.fill(df, ["key"], "t", "v", "previous")) == [None, 1, 1, 1, 1, 5, 5]
    assert column(series.fill(df, ["key"], "t", "v", "next")) == [1, 1, 5, 5, 5, 5, None]
    assert column(series.fill(df, ["key"], "t", "v", "nearest")) == [1, 1, 1, 5, 5, 5, 5]
    assert column(series.fill(df, ["key"], "t", "v", "linear")) == [None, 1, 2, 3, 4, 5, None]
    assert column(series.trim(df, ["key"], "t", "v")) [0] == 1 and series.trim(df, ["key"], "t", "v").count() == 5
    ends = series.first_last(df, ["key"], "t", "v").first()
    assert (ends["first_at"], ends["last_at"]) == (1, 5)
    spline = column(FC.fill_spline(df, ["key"], "t", "v"))
    assert spline[0] is None or math.isnan(spline[0])
    assert np.allclose(spline[1:6], [1, 2, 3, 4, 5])


def test_natural_spline_bends():
    got = FC.natural_spline(np.array([0.0, 1, 2]), np.array([0.0, 1, 0]), np.array([0.5, 1.5]))
    assert np.allclose(got, [0.6875, 0.6875])


def test_differences_and_back(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    df = frame(spark, values)
    assert column(series.differences(df, ["key"], "t", "v", 2)) == [3, 1, 1, 0, 1, 8, -3, -3]
    assert column(series.inverse_differences(series.differences(df, ["key"], "t", "v", 3), ["key"], "t", "v", 3)) == values
    twice = series.differences_of_order(df, ["key"], "t", "v", 2)
    assert column(twice)[:4] == [3, -2, 5, -6]
    assert column(series.inverse_differences_of_order(twice, ["key"], "t", "v", 2)) == values


def test_resampling(spark):
    df = frame(spark, range(10))
    assert column(series.downsample(df, ["key"], "t", 3, 1)) == [1, 4, 7]
    up = series.upsample(frame(spark, [7, 8]), ["key"], "t", "v", 3, zero=True).orderBy("index").collect()
    assert [(r["index"], r["v"]) for r in up] == [(0, 7), (1, 0), (2, 0), (3, 8), (4, 0), (5, 0)]


def test_ar_recovers_parameters(spark):
    rng = np.random.default_rng(1)
    y = [0.0, 0.0]
    for _ in range(5000):
        y.append(1.5 + 0.2 * y[-1] + 0.3 * y[-2] + rng.normal())
    fit = series.autoregression(frame(spark, y[100:]), ["key"], "t", "v", 2).first()
    c, a, b = fit["coefficients"]
    assert abs(c - 1.5) < 0.15 and abs(a - 0.2) < 0.05 and abs(b - 0.3) < 0.05
    model = series.autoregression(frame(spark, y[100:]), ["key"], "t", "v", 2)
    left = series.remove_ar_effects(frame(spark, y[100:]), ["key"], "t", "v", model, 2)
    assert abs(left.where("t > 2").agg(F.stddev("v")).first()[0] - 1) < 0.05


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2, -1] + rng.normal(size=60)
    df = spark.createDataFrame([("k", *map(float, r), float(v)) for r, v in zip(x, y)], "key string, a double, b double, y double")
    fit = series.least_squares(df, ["key"], "y", ["a", "b"]).first()
    design = np.c_[np.ones(60), x]
    beta, ssr, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert np.allclose(fit["coefficients"], beta) and np.isclose(fit["ssr"], ssr[0])
    errors = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * ssr[0] / 57)
    assert np.allclose(fit["std_errors"], errors)


def test_stationarity_tests_tell_walks_from_noise(spark):
    rng = np.random.default_rng(4)
    noise = rng.normal(size=400)
    df = frame(spark, noise, "noise").union(frame(spark, np.cumsum(noise), "walk"))
    p = {r["key"]: r["p_value"] for r in series.adf_test(df, ["key"], "t", "v", 2).collect()}
    assert p["noise"] < 0.01 and p["walk"] > 0.05
    stat = {r["key"]: r["statistic"] for r in series.kpss_test(df, ["key"], "t", "v").collect()}
    assert stat["noise"] < series.KPSS_CRITICAL["c"][0] and stat["walk"] > series.KPSS_CRITICAL["c"][3]
    assert np.isclose(stat["walk"], FC.kpss_level(np.cumsum(noise)))


def test_unit_root_with_quadratic_trend(spark):
    """The statistic of the regression on level, trend, squared trend, last value and two differences, against numpy."""
    rng = np.random.default_rng(11)
    n = 300
    y = 0.002 * np.arange(n) ** 2 + rng.normal(0, 1, n)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "key string, t int, v double")
    got = series.adf_test(df, ["key"], "t", "v", 2, "ctt").first()
    d = np.diff(y)
    pos = np.arange(3, n)
    x = np.column_stack([np.ones(n - 3), y[2:-1], d[1:-1], d[:-2], pos, (pos / n) ** 2])
    beta, *_ = np.linalg.lstsq(x, d[2:], rcond=None)
    sigma = ((d[2:] - x @ beta) ** 2).sum() / (len(pos) - x.shape[1])
    t = beta[1] / np.sqrt(sigma * np.linalg.inv(x.T @ x)[1, 1])
    assert np.isclose(got["statistic"], t, rtol=1e-5) and got["p_value"] < 0.01
    assert abs(numeric.mackinnon_p(-3.83, "ctt") - 0.05) < 0.005


def test_tails():
    assert abs(numeric.chi2_tail(3.841459, 1) - 0.05) < 1e-6
    assert abs(numeric.chi2_tail(18.307038, 10) - 0.05) < 1e-6
    assert abs(numeric.mackinnon_p(-2.86, "c") - 0.05) < 0.005


def test_residual_tests(spark):
    rng = np.random.default_rng(5)
    x = np.arange(300) / 300
    e = rng.normal(size=300)
    ar = [0.0]
    for v in e[1:]:
        ar.append(0.7 * ar[-1] + v)
    rows = [("white", i, float(a), float(b)) for i, (a, b) in enumerate(zip(e, x))] + [("ar", i, float(a), float(b)) for i, (a, b) in enumerate(zip(ar, x))] \
        + [("fan", i, float(a * b * 5), float(b)) for i, (a, b) in enumerate(zip(e, x))]
    df = spark.createDataFrame(rows, "key string, t int, v double, x double")
    bg = {r["key"]: r["p_value"] for r in series.breusch_godfrey(df, ["key"], "t", "v", ["x"], 2).collect()}
    bp = {r["key"]: r["p_value"] for r in series.breusch_pagan(df, ["key"], "v", ["x"]).collect()}
    lb = {r["key"]: r["p_value"] for r in series.ljung_box(df, ["key"], "t", "v", 5).collect()}
    dw = {r["key"]: r["dw"] for r in series.durbin_watson(df, ["key"], "t", "v").collect()}
    assert bg["ar"] < 0.001 < bg["white"] and bp["fan"] < 0.001 < bp["white"] and lb["ar"] < 0.001 < lb["white"]
    assert dw["ar"] < 1 and 1.7 < dw["white"] < 2.3


def test_holt_winters_matches_published_weights():
    y = np.array(PASSENGERS, float)
    additive = FC.HoltWinters(12).fit(y)
    assert np.allclose(additive.weights, (0.2479595, 0.0345373, 1.0), atol=0.01)
    times = FC.HoltWinters(12, additive=False).fit(y)
    assert np.allclose(times.weights, (0.2755925, 0.03269295, 0.8707292), atol=0.02)
    ahead = times.forecast(y, 12)
    assert abs(ahead[0] - 445) < 8 and ahead[6] == max(ahead)


def test_ewma():
    data = [3.0, 5.0, 4.0, 8.0]
    smooth = FC.ewma_smooth(data, 0.5)
    assert smooth == [3.0, 4.0, 4.0, 6.0] and np.allclose(FC.ewma_restore(smooth, 0.5), data)
    assert FC.ewma_fit(np.cumsum(np.ones(50))) > 0.99


def test_garch():
    rng = np.random.default_rng(8)
    omega, alpha, beta = 0.2, 0.3, 0.5
    y = np.array(FC.garch_apply(rng.normal(size=20000).tolist(), omega, alpha, beta))
    got = FC.garch_fit(y[:8000])
    assert np.allclose(got, (omega, alpha, beta), atol=0.08)
    z = FC.garch_standardize(y.tolist(), omega, alpha, beta)
    assert abs(np.std(z) - 1) < 0.03 and np.allclose(FC.garch_apply(z, omega, alpha, beta), y)


def test_arima():
    rng = np.random.default_rng(9)
    y, e = [0.0], rng.normal(size=3000)
    for t in range(1, 3000):
        y.append(0.3 + 0.6 * y[-1] + e[t] + 0.4 * e[t - 1])
    fit = FC.Arima(1, 0, 1).fit(np.array(y))
    assert np.allclose(fit.params, (0.3, 0.6, 0.4), atol=0.08)
    line = np.arange(60) * 2.0 + rng.normal(size=60) * 0.01
    auto = FC.auto_arima(line, 2, 2, 1)
    assert auto.d >= 1 and np.allclose(auto.forecast(line, 3), [120, 122, 124], atol=0.5)
    x = rng.normal(size=(500, 1))
    with_x = FC.Arima(1, 0, 0).fit(np.array(y)[:500] * 0.01 + 5 * x[:, 0], x)
    assert abs(with_x.params[2] - 5) < 0.5


def test_forecast_and_backtest_jobs(spark):
    start = dt.datetime(2018, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=i), float(v), float(v) / 2) for i, v in enumerate(PASSENGERS)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, b double, c double")
    out = FC.forecast(df, ["key"], "ts", ["b", "c"], 12, period=12, additive=False).collect()
    assert len(out) == 24 and {r["field"] for r in out} == {"b", "c"}
    first = min((r for r in out if r["field"] == "b"), key=lambda r: r["ts"])
    assert first["ts"] == start + dt.timedelta(seconds=144) and abs(first["value"] - 445) < 8
    tested = FC.backtest(df, ["key"], "ts", ["b"], period=12, additive=False)
    assert tested.count() == 71
    model = FC.model_rows(tested, ["key"])
    assert model.first()["rmse"] < 100
    again = FC.forecast(df, ["key"], "ts", ["b"], 3, models=model)
    assert again.count() == 3


def test_guard_refuses_long_series(spark):
    import pytest

    with pytest.raises(ValueError):
        FC.guard(frame(spark, range(20)), ["key"], limit=10)
