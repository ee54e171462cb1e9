"""Queries over per-key time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import Tables, query
from flowspark.operators import forecast as FC
from flowspark.operators import series as S

C = F.col
K = ["event_type"]


def _s(t: Tables):
    return t.events.select("event_type", "event_id", "ts", "value")


def _gaps(t: Tables):
    """Every value below 25 is a gap."""
    return t.events.select("event_type", "event_id", "ts", F.when(C("value") >= 25, C("value")).otherwise(F.lit(float("nan"))).alias("value"))


_P = "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events"
_G = f"SELECT *, CASE WHEN value >= 25 THEN value END AS v FROM ({_P})"


@query("z01_lag_matrix", f"""
SELECT event_id, value, lag(value, 1) OVER w AS lag1, lag(value, 2) OVER w AS lag2 FROM ({_P})
WINDOW w AS (PARTITION BY event_type ORDER BY ts) QUALIFY pos > 2""")
def _(t: Tables):
    return S.lag_matrix(_s(t), K, "ts", "value", 2).select("event_id", "value", "lag1", "lag2")


@query("z02_autocorrelation", f"""
WITH l AS (SELECT event_type, value AS v, k AS lag, lag(value, k) OVER (PARTITION BY event_type, k ORDER BY ts) AS b FROM events, range(1, 4) r(k))
SELECT event_type, CAST(lag AS INTEGER) AS lag, round(corr(v, b), 8) AS acf FROM l WHERE b IS NOT NULL GROUP BY ALL""")
def _(t: Tables):
    return S.autocorrelation(_s(t), K, "ts", "value", 3).withColumn("acf", F.round("acf", 8))


@query("z03_quotients_returns", f"""
SELECT event_id, round(value / lag(value, 2) OVER w, 8) AS quotient, round(value / lag(value, 2) OVER w - 1, 8) AS ret FROM ({_P})
WINDOW w AS (PARTITION BY event_type ORDER BY ts) QUALIFY pos > 2""")
def _(t: Tables):
    out = S.quotients(_s(t), K, "ts", "value", 2)
    return out.select("event_id", F.round("quotient", 8).alias("quotient"), F.round(C("quotient") - 1, 8).alias("ret"))


@query("z04_trim", f"""
WITH e AS (SELECT event_type, min(ts) FILTER (WHERE v IS NOT NULL) AS a, max(ts) FILTER (WHERE v IS NOT NULL) AS b FROM ({_G}) GROUP BY 1)
SELECT event_id FROM events JOIN e USING (event_type) WHERE ts BETWEEN a AND b""")
def _(t: Tables):
    return S.trim(_gaps(t), K, "ts", "value").select("event_id")


@query("z05_fill_value", "SELECT event_id, CASE WHEN value >= 25 THEN value ELSE 0 END AS value FROM events")
def _(t: Tables):
    return S.fill_value(_gaps(t), "value").select("event_id", "value")


@query("z06_fill_previous_next", f"""
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS prev,
       first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM ({_G})""")
def _(t: Tables):
    back = S.fill(_gaps(t), K, "ts", "value", "previous").select("event_id", C("value").alias("prev"))
    on = S.fill(_gaps(t), K, "ts", "value", "next").select("event_id", C("value").alias("next"))
    return back.join(on, "event_id")


_NEAR = f"""
WITH f AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, max(CASE WHEN v IS NOT NULL THEN pos END) OVER b AS pp,
  first_value(v IGNORE NULLS) OVER a AS nv, min(CASE WHEN v IS NOT NULL THEN pos END) OVER a AS np FROM ({_G})
  WINDOW b AS (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


@query("z07_fill_nearest", _NEAR + """
SELECT event_id, CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv WHEN pos - pp < np - pos THEN pv ELSE nv END AS value FROM f""")
def _(t: Tables):
    return S.fill(_gaps(t), K, "ts", "value", "nearest").select("event_id", "value")


@query("z08_fill_linear", _NEAR + """
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v ELSE pv + (nv - pv) / (np - pp) * (pos - pp) END, 8) AS value FROM f""")
def _(t: Tables):
    return S.fill(_gaps(t), K, "ts", "value", "linear").select("event_id", F.round("value", 8).alias("value"))


@query("z09_fill_spline")
def _(t: Tables):
    slots = FC.slots(t.events, K, "ts", ["value"], "hour").withColumn("value", F.when(C("value") >= 40, C("value")))
    return FC.fill_spline(slots, K, "ts", "value").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.isnan("value")).alias("filled"))


@query("z10_resample", f"""
SELECT 'down' AS how, event_type, CAST(pos AS BIGINT) AS idx, value FROM ({_P}) WHERE (pos - 1 - 1) % 5 = 0
UNION ALL SELECT 'up', event_type, (pos - 1) * 3 + o, CASE WHEN o = 1 THEN value END FROM ({_P}), range(3) r(o)""")
def _(t: Tables):
    from flowspark.plans.scale import ordered

    placed = ordered(_s(t), K, ["ts"]).select("event_type", "event_id", "ts", "value", C("_pos").alias("idx"))
    down = S.downsample(placed, K, "ts", 5, 1).select(F.lit("down").alias("how"), "event_type", "idx", "value")
    up = S.upsample(_s(t), K, "ts", "value", 3, 1).select(F.lit("up").alias("how"), "event_type", C("index").alias("idx"), "value")
    return down.unionByName(up)


@query("z11_differences", f"""
SELECT event_id, round(CASE WHEN pos <= 3 THEN value ELSE value - lag(value, 3) OVER (PARTITION BY event_type ORDER BY ts) END, 6) AS diff, value AS again FROM ({_P})""")
def _(t: Tables):
    diff = S.differences(_s(t), K, "ts", "value", 3)
    back = S.inverse_differences(diff, K, "ts", "value", 3).select("event_id", F.round("value", 2).alias("again"))
    return diff.select("event_id", F.round("value", 6).alias("diff")).join(back, "event_id")


@query("z12_differences_of_order", f"""
SELECT event_id, round(CASE WHEN pos = 1 THEN value WHEN pos = 2 THEN value - lag(value) OVER w ELSE value - 2 * lag(value) OVER w + lag(value, 2) OVER w END, 6) AS diff,
       value AS again FROM ({_P}) WINDOW w AS (PARTITION BY event_type ORDER BY ts)""")
def _(t: Tables):
    diff = S.differences_of_order(_s(t), K, "ts", "value", 2)
    back = S.inverse_differences_of_order(diff, K, "ts", "value", 2).select("event_id", F.round("value", 2).alias("again"))
    return diff.select("event_id", F.round("value", 6).alias("diff")).join(back, "event_id")


@query("z13_rolling_sum", f"""
SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS roll_sum FROM ({_P}) QUALIFY pos >= 7""")
def _(t: Tables):
    return S.rolling_sum(_s(t), K, "ts", "value", 7).select("event_id", F.round("roll_sum", 6).alias("roll_sum"))


@query("z14_autoregression", f"""
WITH l AS (SELECT event_type, value AS v, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS b FROM events)
SELECT event_type, round(regr_intercept(v, b), 6) AS c, round(regr_slope(v, b), 6) AS phi FROM l GROUP BY 1""")
def _(t: Tables):
    fit = S.autoregression(_s(t), K, "ts", "value", 1)
    return fit.select("event_type", F.round(C("coefficients")[0], 6).alias("c"), F.round(C("coefficients")[1], 6).alias("phi"))


@query("z15_autoregression_x")
def _(t: Tables):
    df = t.events.select("event_type", "ts", "value", (C("user_id") % 7).cast("double").alias("x"))
    return S.autoregression_x(df, K, "ts", "value", ["x"], 2, 1).select("event_type", "n", "coefficients", "r2")


def _fit_rows(t: Tables, fit, schema: str):
    slots = FC.slots(t.events, K, "ts", ["value"], "hour")
    return FC.per_series(slots, K, "ts", "value", fit, schema)


@query("z16_arima")
def _(t: Tables):
    def fit(times, values):
        model = FC.auto_arima(values, 2, 1, 2)
        return {"p": [model.p], "d": [model.d], "q": [model.q], "next": [model.forecast(values, 1)[0]]}

    return _fit_rows(t, fit, "p int, d int, q int, next double")


@query("z17_arimax")
def _(t: Tables):
    def fit(times, values):
        import numpy as np

        x = np.sin(np.arange(len(values) + 3) / 4.0)[:, None]
        model = FC.Arima(1, 0, 1).fit(values, x[:len(values)])
        return {"params": [[float(v) for v in model.params]], "ahead": [model.forecast(values, 3, x[:len(values)], x[len(values):])]}

    return _fit_rows(t, fit, "params array<double>, ahead array<double>")


@query("z18_ewma")
def _(t: Tables):
    def fit(times, values):
        a = FC.ewma_fit(values)
        smooth = FC.ewma_smooth(list(values), a)
        return {"smoothing": [a], "last": [smooth[-1]], "restored": [FC.ewma_restore(smooth, a)[-1] - values[-1]]}

    return _fit_rows(t, fit, "smoothing double, last double, restored double")


@query("z19_z20_garch")
def _(t: Tables):
    def fit(times, values):
        return {k: [v] for k, v in FC.ar_garch_fit(values).items()}

    return _fit_rows(t, fit, "c double, phi double, omega double, alpha double, beta double")


@query("z21_holt_winters")
def _(t: Tables):
    def fit(times, values):
        hw = FC.HoltWinters(24).fit(values)
        return {"alpha": [hw.weights[0]], "beta": [hw.weights[1]], "gamma": [hw.weights[2]], "next": [hw.forecast(values, 1)[0]]}

    return _fit_rows(t, fit, "alpha double, beta double, gamma double, next double")


@query("z22_stationarity")
def _(t: Tables):
    adf = S.adf_test(_s(t), K, "ts", "value", 2).select("event_type", C("statistic").alias("adf"), "p_value")
    kpss = S.kpss_test(_s(t), K, "ts", "value", 5).select("event_type", C("statistic").alias("kpss"))
    return adf.join(kpss, "event_type")


@query("z23_durbin_watson", """
WITH l AS (SELECT event_type, value AS v, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS b FROM events)
SELECT event_type, round(sum((v - b) ** 2) / sum(v ** 2), 8) AS dw FROM l GROUP BY 1""")
def _(t: Tables):
    return S.durbin_watson(_s(t), K, "ts", "value").withColumn("dw", F.round("dw", 8))


@query("z24_ljung_box", """
WITH l AS (SELECT event_type, value AS v, k AS lag, lag(value, k) OVER (PARTITION BY event_type, k ORDER BY ts) AS b FROM events, range(1, 6) r(k)),
a AS (SELECT event_type, lag, corr(v, b) AS r, count(*) AS n FROM l GROUP BY ALL)
SELECT event_type, round(max(n) * (max(n) + 2) * sum(r * r / (n - lag)), 6) AS statistic FROM a GROUP BY 1""")
def _(t: Tables):
    out = S.ljung_box(_s(t), K, "ts", "value", 5)
    return out.select("event_type", F.round("statistic", 6).alias("statistic"))


@query("z25_residual_tests")
def _(t: Tables):
    df = t.events.select("event_type", "ts", "value", (C("user_id") % 7).cast("double").alias("x"))
    bg = S.breusch_godfrey(df, K, "ts", "value", ["x"], 2).select("event_type", C("statistic").alias("bg"), C("p_value").alias("bg_p"))
    bp = S.breusch_pagan(df, K, "value", ["x"]).select("event_type", C("statistic").alias("bp"), C("p_value").alias("bp_p"))
    return bg.join(bp, "event_type")


@query("z26_forecast")
def _(t: Tables):
    slots = FC.slots(t.events, K, "ts", ["value"], "hour")
    out = FC.forecast(slots, K, "ts", ["value"], 6 * 3600, period=24)
    return out.select("event_type", "field", F.unix_millis("ts").alias("ms"), "value")


@query("z27_backtest")
def _(t: Tables):
    slots = FC.slots(t.events, K, "ts", ["value"], "hour")
    return FC.model_rows(FC.backtest(slots, K, "ts", ["value"], period=24), K)


@query("z22_kpss", f"""
WITH e AS (SELECT event_type, ts, n, value - avg(value) OVER (PARTITION BY event_type) AS e FROM ({_P})),
s AS (SELECT *, sum(e) OVER w AS s, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT event_type, round(sum(s * s) / max(n) / (sum(e * e) + 2 * (0.75 * sum(e * e1) + 0.5 * sum(e * e2) + 0.25 * sum(e * e3))), 6) AS statistic FROM s GROUP BY 1""")
def _(t: Tables):
    return S.kpss_test(_s(t), K, "ts", "value", 3).select("event_type", F.round("statistic", 6).alias("statistic"))


@query("z25_breusch_pagan", """
SELECT event_type, round(count(*) * regr_r2(value * value, user_id % 7), 6) AS statistic FROM events GROUP BY 1""")
def _(t: Tables):
    df = t.events.select("event_type", "value", (C("user_id") % 7).cast("double").alias("x"))
    return S.breusch_pagan(df, K, "value", ["x"]).select("event_type", F.round("statistic", 6).alias("statistic"))
