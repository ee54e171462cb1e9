"""Queries that run as streams over the table files until all data is processed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.catalog.base import Tables, query
from flowspark.functions import parse
from flowspark.operators import forecast as FC
from flowspark.operators import models
from flowspark.operators import rules as R
from flowspark.plans.scale import last_per_key, lookup_join, ordered, shared_folder
from flowspark.sources.sinks import write_once
from flowspark.streaming import joins, lookup, processors, windows

C = F.col


def _plain(t: Tables, name: str = "events") -> DataFrame:
    """A table's file as a stream."""
    return t.spark.readStream.schema(getattr(t, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def _stream(t: Tables, name: str = "events", delay: str = "10 seconds", end: windows.Closing | None = None) -> DataFrame:
    """A table's file as a stream with event time."""
    df = _plain(t, name) if end is None else end.attach(_plain(t, name))
    return windows.event_time(df, "ts", delay) if "ts" in df.columns else df


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


@query("g02_tumbling_stream", """
SELECT epoch_ms(w) AS w_start, event_type, count(*) AS n, round(sum(value), 2) AS total
FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events) GROUP BY w, event_type""")
def _(t: Tables):
    end = windows.Closing(t.spark, "ts")
    out = end.finished(windows.window_aggregate(_stream(t, end=end), windows.tumbling("ts", "1 hour"), ["event_type"],
                                                n=F.count(F.lit(1)), total=F.sum("value")))
    return out.select(F.unix_millis("w_start").alias("w_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("g03_sliding_stream", """
SELECT epoch_ms(w) AS w_start, count(*) AS n FROM (
  SELECT ts, time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE AS w FROM events, range(4) r(o))
GROUP BY w""")
def _(t: Tables):
    end = windows.Closing(t.spark, "ts")
    out = end.finished(windows.window_aggregate(_stream(t, end=end), windows.sliding("ts", "2 hours", "30 minutes"), [], n=F.count(F.lit(1))))
    return out.select(F.unix_millis("w_start").alias("w_start"), "n")


@query("g04_session_stream", """
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s)
SELECT user_id, epoch_us(min(ts)) // 1000 AS w_start, count(*) AS n FROM g GROUP BY user_id, g""")
def _(t: Tables):
    end = windows.Closing(t.spark, "ts")
    out = end.finished(windows.window_aggregate(_stream(t, end=end), windows.session("ts", "3 hours"), ["user_id"], n=F.count(F.lit(1))))
    return out.select("user_id", F.unix_millis("w_start").alias("w_start"), "n")


@query("g05_arrival_time_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    end = windows.Closing(t.spark, "arrived")
    rows = end.attach(_plain(t).select("event_type").withColumn("arrived", F.lit(None).cast("timestamp")))
    out = end.finished(windows.window_aggregate(windows.arrival_time(rows), windows.tumbling("arrived", "1 hour"), ["event_type"], n=F.count(F.lit(1))))
    # every row is in exactly one window, whenever it came
    return out.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("g06_stream_sql", """
SELECT epoch_ms(w) AS w_start, event_type, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS w FROM events)
WHERE event_type <> 'error' GROUP BY ALL""")
def _(t: Tables):
    end = windows.Closing(t.spark, "ts", {"event_type": "view"})
    _stream(t, end=end).createOrReplaceTempView("live_events")
    out = t.spark.sql("""SELECT window.start AS w_start, event_type, count(*) AS n FROM live_events WHERE event_type <> 'error'
                         GROUP BY window(ts, '1 day'), event_type""")
    return end.finished(out).select(F.unix_millis("w_start").alias("w_start"), "event_type", "n")


@query("g07_changing_result", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, max(ts) AS latest FROM events GROUP BY 1")
def _(t: Tables):
    log = windows.finished(processors.changes(_plain(t), ["event_type"], n=("count", None), total=("sum", "value"), latest=("max", "ts")))
    sign = F.when(C("change") == "insert", 1).otherwise(-1)
    # inserts minus retracts leave the final values
    return log.groupBy("event_type").agg(F.sum(sign * C("n")).alias("n"), F.round(F.sum(sign * C("total")), 2).alias("total"),
                                         F.max(F.when(C("change") == "insert", C("latest"))).alias("latest"))


#: a third of the events, those of the first user ids, come after all others
_LAST = "user_id % 3 = 0"


@query("g09_late_rows", f"""
WITH e AS (SELECT *, {_LAST} AS last FROM events),
seen AS (SELECT max(ts) - INTERVAL 10 SECOND AS mark FROM e WHERE NOT last)
SELECT CASE WHEN last AND ts < date_trunc('milliseconds', mark) THEN 'late' ELSE 'in time' END AS part, count(*) AS n, round(sum(value), 2) AS total
FROM e, seen GROUP BY 1""")
def _(t: Tables):
    # two files, read one by one: the second is behind the watermark that the first has set
    folder = _folder(t)
    t.events.where(f"NOT ({_LAST})").write.parquet(f"{folder}/in/one")
    first = t.spark.readStream.schema(t.events.schema).parquet(f"{folder}/in/*")
    marked = processors.mark_late(windows.event_time(first, "ts"), "ts")
    windows.run_to_table(marked, folder=folder)
    t.events.where(_LAST).write.parquet(f"{folder}/in/two")
    out = windows.read_result(t.spark, windows.run_to_table(marked, folder=folder), marked.schema)
    return out.groupBy(F.when(C("late"), "late").otherwise("in time").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("g10_rolling_state", """
SELECT user_id, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1 AS pos, value
FROM events QUALIFY count(*) OVER (PARTITION BY user_id) > 2""")
def _(t: Tables):
    parts = windows.finished(processors.rolling_series(_plain(t), "user_id", "ts", "value"))
    newest = last_per_key(parts, ["user_id", "part"], ["total"])
    points = newest.select("user_id", F.explode(F.arrays_zip("times", "values")).alias("p")).select("user_id", "p.*")
    totals = parts.groupBy("user_id").agg(F.max("total").alias("total"))
    placed = ordered(points, ["user_id"], ["times", "values"])
    return lookup_join(placed, totals, ["user_id"]).select("user_id", "total", (C("_pos") - 1).alias("pos"), C("values").alias("value"))


@query("g11_window_forecast", """
SELECT event_type, epoch_ms(w) AS w_start, count(*) AS points FROM (
  SELECT DISTINCT event_type, h, time_bucket(INTERVAL 1 DAY, h) AS w FROM (SELECT event_type, date_trunc('hour', ts) AS h FROM events)) GROUP BY ALL""")
def _(t: Tables):
    end = windows.Closing(t.spark, "ts")
    packed = windows.window_series(_stream(t, end=end), "ts", ["event_type"], "value", "1 hour", "1 day", "1 day")
    folder = _folder(t)

    def each(batch, number):
        rows = batch.select("event_type", C("w_start").alias("w"), F.explode("points").alias("p")).select("event_type", "w", C("p.t").alias("ts"), C("p.v").alias("value"))
        ahead = FC.forecast(rows, ["event_type", "w"], "ts", ["value"], 3 * 3600, "arima").fillna(0.0, ["value"])
        counts = rows.groupBy("event_type", "w").agg(F.count(F.lit(1)).alias("points"))
        next_ = ahead.groupBy("event_type", "w").agg(F.count(F.lit(1)).alias("ahead"))
        counts.join(next_, ["event_type", "w"], "left").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    end.run_to_table(packed, "append", each, folder)
    out = windows.read_result(t.spark, f"{folder}/out", "event_type string, w timestamp, points long, ahead long")
    return out.select("event_type", F.unix_millis("w").alias("w_start"), "points")


@query("g12_score_stream", "SELECT event_id, round(1 + 2 * value - 0.5 * user_id, 6) AS label FROM events")
def _(t: Tables):
    model = lookup.Refreshed(lambda: t.spark.createDataFrame([(1.0, "dense", 2, [2.0, -0.5])], models.LINEAR), 60)
    folder = _folder(t)
    ready = _stream(t).select("event_id", F.array("value", C("user_id").cast("double")).alias("x"))
    windows.run_to_table(ready, "append", lookup.scored(
        model, lambda df, m: models.score_linear(df, m, "x"), write_once(f"{folder}/out")), folder)
    return t.spark.read.parquet(f"{folder}/out").select("event_id", F.round("label", 6).alias("label"))


@query("g13_stream_rules", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'kind-' || event_type AS tag FROM events WHERE event_type <> 'error'""")
def _(t: Tables):
    df = parse.parse(_stream(t).select("event_id", "event_type", "props"), "props", parse.json("k bigint"))
    df = R.apply_rules(df, [R.drop_rows(C("event_type") == "error"), R.add_fields({"tag": "kind-%{event_type}"})])
    return windows.finished(df.select("event_id", "k", "tag"))


_PAIR = f"""
WITH e AS (SELECT event_id, user_id, event_type, {{bucket}} AS w FROM events {{more}})
SELECT epoch_ms(a.w) AS w_start, a.event_id AS l_event_id, b.event_id AS r_event_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.w = b.w
WHERE a.event_type = 'click' AND b.event_type = 'purchase'"""


@query("j03_tumbling_stream_join", _PAIR.format(bucket="time_bucket(INTERVAL 6 HOUR, ts)", more=""))
def _(t: Tables):
    left, right = _stream(t).where("event_type = 'click'"), _stream(t).where("event_type = 'purchase'")
    cols = ["event_id", "user_id", "ts"]
    out = joins.window_join(left.select(*cols), right.select(*cols), [("user_id", "user_id")], "ts", "ts", "6 hours")
    return windows.finished(out).select(F.unix_millis("w_start").alias("w_start"), "l_event_id", "r_event_id")


@query("j04_sliding_stream_join", _PAIR.format(bucket="time_bucket(INTERVAL 3 HOUR, ts) - o * INTERVAL 3 HOUR", more=", range(2) r(o)"))
def _(t: Tables):
    left, right = _stream(t).where("event_type = 'click'"), _stream(t).where("event_type = 'purchase'")
    cols = ["event_id", "user_id", "ts"]
    out = joins.window_join(left.select(*cols), right.select(*cols), [("user_id", "user_id")], "ts", "ts", "6 hours", "3 hours")
    return windows.finished(out).select(F.unix_millis("w_start").alias("w_start"), "l_event_id", "r_event_id")


@query("j05_session_stream_join", """
WITH u AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')),
s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM u),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s),
c AS (SELECT user_id, g, min(ts) AS a FROM g GROUP BY ALL)
SELECT epoch_us(a) // 1000 AS w_start, x.event_id AS l_event_id, y.event_id AS r_event_id FROM c JOIN g x USING (user_id, g) JOIN g y USING (user_id, g)
WHERE x.event_type = 'click' AND y.event_type = 'purchase'""")
def _(t: Tables):
    end = windows.Closing(t.spark, "ts", {"event_type": "click"})
    other = windows.Closing(t.spark, "ts", {"event_type": "purchase"})
    cols = ["event_id", "user_id", "ts"]
    left = _stream(t, end=end).where("event_type = 'click'").select(*cols)
    right = _stream(t, end=other).where("event_type = 'purchase'").select(*cols)
    out = processors.session_join(left, right, [("user_id", "user_id")], "ts", "ts", 3600)
    return end.finished(out, beside=[other]).select(F.unix_millis("w_start").alias("w_start"), "l_event_id", "r_event_id")


@query("j06_arrival_stream_join", """
SELECT a.event_id AS l_event_id, b.event_id AS r_event_id FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def _(t: Tables):
    left, right = (_plain(t).where(f"event_type = '{kind}'").select("event_id", "user_id") for kind in ("click", "purchase"))
    out = processors.arrival_join(left, right, [("user_id", "user_id")], 366 * 86_400)
    return windows.finished(out).select("l_event_id", "r_event_id")


@query("j07_full_side_table", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0")
def _(t: Tables):
    folder = _folder(t)
    table = lookup.Refreshed(lambda: t.customer.where("c_acctbal > 0").select(C("c_custkey").alias("user_id"), "c_name"), 60)
    windows.run_to_table(_stream(t).select("event_id", "user_id"), "append",
                         lookup.full_lookup(table, ["user_id"], write_once(f"{folder}/out"), "inner"), folder)
    return t.spark.read.parquet(f"{folder}/out").select("event_id", "c_name")


@query("j08_keyed_side_table", "SELECT event_id, c_name FROM events LEFT JOIN customer ON user_id = c_custkey AND c_acctbal > 0")
def _(t: Tables):
    folder = _folder(t)
    step = lookup.keyed_lookup(lambda: t.customer.where("c_acctbal > 0").select("c_custkey", "c_name"), "user_id", "c_custkey", write_once(f"{folder}/out"))
    windows.run_to_table(_stream(t).select("event_id", "user_id"), "append", step, folder)
    return t.spark.read.parquet(f"{folder}/out").select("event_id", "c_name")


@query("j09_side_table_sql", """
SELECT e.event_id, n.n_name FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE e.event_type = 'click'""")
def _(t: Tables):
    for name in ("customer", "nation"):
        getattr(t, name).createOrReplaceTempView(name)
    _stream(t).createOrReplaceTempView("live_events")
    out = t.spark.sql("""SELECT e.event_id, n.n_name FROM live_events e LEFT JOIN customer c ON e.user_id = c.c_custkey
                         JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE e.event_type = 'click'""")
    return windows.finished(out)


@query("k15_idempotent_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    folder = _folder(t)
    write = write_once(f"{folder}/out")

    def twice(batch, number):
        write(batch, number)
        write(batch, number)  # a repeated batch replaces its own output

    windows.run_to_table(_stream(t).select("event_type"), "append", twice, folder)
    return t.spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
