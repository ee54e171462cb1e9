"""Queries that write a table out in some file format and scan it back through the library."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.catalog.base import Tables, query
from flowspark.functions import dates, parse
from flowspark.operators import aggregates as A
from flowspark.operators import models
from flowspark.operators import rules as R
from flowspark.plans.scale import shared_folder
from flowspark.sources import files, framing, sinks
from flowspark.streaming import windows

C = F.col


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


@query("s01_c01_text_lines", "SELECT event_id || ';' || event_type AS line FROM events")
def _(t: Tables):
    path = _folder(t)
    t.events.select(F.concat_ws(";", C("event_id").cast("string"), "event_type")).write.text(path)
    return files.text_lines(t.spark, path).select(C("value").alias("line"))


@query("s02_csv", "SELECT doc_id, text, lang FROM documents")
def _(t: Tables):
    path = _folder(t)
    t.documents.select("doc_id", "text", "lang").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return files.csv(t.spark, path, schema=T._parse_datatype_string("doc_id long, text string, lang string"))


@query("s03_json_lines", "SELECT event_id, user_id, event_type, value FROM events")
def _(t: Tables):
    path = _folder(t)
    t.events.select("event_id", "user_id", "event_type", "value").write.json(path)
    return files.json_lines(t.spark, path, "event_id long, user_id long, event_type string, value double")


@query("s04_k03_orc", "SELECT event_id, event_type, CAST(NULL AS VARCHAR) AS absent FROM events")
def _(t: Tables):
    path = _folder(t)
    sinks.write_orc(t.events, path, T._parse_datatype_string("event_id long, event_type string, absent string"))
    return files.orc(t.spark, path)


@query("s05_directory_watch", "SELECT event_type, count(*) AS n FROM events WHERE starts_with(event_type, 'p') OR starts_with(event_type, 'v') GROUP BY 1")
def _(t: Tables):
    path = _folder(t)
    sinks.write_named_files(t.events.select("event_id", "event_type"), path, C("event_type"))
    live = files.watch(t.spark, f"{path}/_name={{p*,v*}}", "json", "event_id long, event_type string", per_trigger=3)
    return windows.finished(live).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s06_wildcards", r"SELECT page_id FROM pages WHERE regexp_full_match(url, 'https?://.*\.example\.(?:com|org)/.*')")
def _(t: Tables):
    return files.matching_names(t.pages, "url", "http?://*.example.{com,org}/*").select("page_id")


@query("s08_s09_resume", """
SELECT 'resumed' AS part, count(*) AS n FROM events WHERE event_id > (SELECT count(*) // 2 FROM events)
UNION ALL SELECT 'from start', count(*) FROM events UNION ALL SELECT 'from end', 0""")
def _(t: Tables):
    store = _folder(t)
    files.save_position(t.spark, store, "events", "1", 2)
    files.save_position(t.spark, store, "events", str(t.events.count() // 2), 1)
    position = files.read_position(t.spark, store, "events")
    parts = {"resumed": files.after_position(t.events, "event_id", position),
             "from start": files.after_position(t.events, "event_id", None),
             "from end": files.after_position(t.events, "event_id", None, "END")}
    rows = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name)) for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("s11_range_query_points", """
SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS usr, CAST(event_id AS DOUBLE) AS time, CAST(user_id * 2 AS VARCHAR) AS value FROM events""")
def _(t: Tables):
    metric = F.struct(C("event_type").alias("kind"), C("user_id").cast("string").alias("usr"))
    point = F.array(C("event_id").cast("string"), (C("user_id") * 2).cast("string"))
    # one answer per row, one series each: the flattening is what is tested
    answers = t.events.select(F.to_json(F.array(F.struct(metric.alias("metric"), F.array(point).alias("values")))).alias("answer"))
    return files.range_query_points(answers, "answer", ["kind", "usr"])


@query("s12_preview")
def _(t: Tables):
    return files.preview(t.embeddings.orderBy("vec_id"), 10)


@query("s12_preview_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey LIMIT 10")
def _(t: Tables):
    return files.preview(t.nation.select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey"), 10)


@query("s13_source_columns", "SELECT 'events.parquet' AS file, count(*) AS n, count(*) AS received FROM events")
def _(t: Tables):
    out = files.with_source(t.events)
    return out.groupBy(F.substring_index("_path", "/", -1).alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.count("_received_at").alias("received"))


@query("c02_delimiter_framing", "SELECT doc_id || ':' || text AS record FROM documents")
def _(t: Tables):
    path = _folder(t)
    t.documents.select(F.concat_ws(":", C("doc_id").cast("string"), "text")).write.option("lineSep", "~#~").text(path)
    return framing.delimited_records(t.spark, path, "~#~").select(C("value").alias("record"))


@query("c03_multi_line", """
SELECT source, '@@' || replace(text, chr(10), '') AS record, len(string_split(text, chr(10))) AS n_lines FROM documents""")
def _(t: Tables):
    lines = t.documents.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.when(C("line_no") == 0, F.concat(F.lit("@@"), "line")).otherwise(C("line")))
    out = framing.assemble(lines, ["source"], ["doc_id", "line_no"], "line", "^@@")
    return out.select("source", C("line").alias("record"), "n_lines")


@query("c05_json_objects", """
SELECT event_id, event_type || ' {' || user_id || '} "x' AS note, user_id AS deep FROM events""")
def _(t: Tables):
    path = _folder(t)
    note = F.concat(C("event_type"), F.lit(" {"), C("user_id").cast("string"), F.lit('} "x'))
    body = F.to_json(F.struct("event_id", note.alias("note"), F.struct(C("user_id").alias("deep")).alias("in")))
    t.events.select(F.concat(body, F.when(C("event_id") % 3 == 0, F.lit("\n")).otherwise(F.lit("")))).write.option("lineSep", " ").text(path)
    out = parse.parse(framing.json_objects(t.spark, path).select("value"), "value", parse.json("event_id long, note string, `in` struct<deep: long>"))
    return out.where("_error IS NULL").select("event_id", "note", C("in.deep").alias("deep"))


@query("c06_xml_records", "SELECT event_id, event_type, value FROM events")
def _(t: Tables):
    path = _folder(t)
    t.events.select("event_id", "event_type", "value").write.format("xml").option("rowTag", "event").option("rootTag", "events").save(path)
    schema = T._parse_datatype_string("event_id long, event_type string, value double")
    return framing.xml_records(t.spark, path, "event", schema)


@query("p04_xml_parse", """
SELECT event_id, event_type || ' & <5' AS a, [CAST(user_id AS VARCHAR), 'y'] AS b FROM events""")
def _(t: Tables):
    line = F.concat(F.lit("<r>\u0001<a>"), C("event_type"), F.lit(" & <5</a><b>"), C("user_id").cast("string"), F.lit("</b><b>y</b></r>"))
    out = parse.parse(t.events.select("event_id", line.alias("line")), "line", parse.xml("a string, b array<string>"))
    return out.where("_error IS NULL").select("event_id", "a", "b")


@query("p14_event_time", """
SELECT event_id, epoch_ms(date_trunc('second', CASE WHEN ts > TIMESTAMP '2024-01-15 00:00:00' THEN ts - INTERVAL 1 YEAR ELSE ts END)) AS ms FROM events""")
def _(t: Tables):
    parts = {"month": F.date_format("ts", "MMMM"), "day": F.date_format("ts", "d"), "hour": F.hour("ts"), "minute": F.minute("ts"),
             "second": F.second("ts")}
    return t.events.select("event_id", F.unix_millis(dates.guess_event_time(parts, F.lit("2024-01-15 00:00:00"))).alias("ms"))


@query("a08_observed_counts", """
SELECT count(*) AS n_in, count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) FILTER (WHERE event_type = 'error') AS fail FROM events""")
def _(t: Tables):
    from pyspark.sql import Observation

    seen = Observation("write")
    marked = t.events.transform(R.mark_error("bad", C("event_type") == "error"))
    A.channel_counts(marked, seen).write.parquet(_folder(t))
    got = seen.get
    return t.spark.createDataFrame([(got["in"], got["success"], got["fail"])], "n_in long, success long, fail long")


@query("k01_written_routes", """
SELECT CASE WHEN event_type = 'error' THEN 'alerts' WHEN starts_with(event_type, 'p') THEN 'sales' ELSE 'default' END AS route, count(*) AS n FROM events GROUP BY 1""")
def _(t: Tables):
    path = _folder(t)
    names = ("alerts", "sales", "default")
    writers = {n: (lambda df, n=n: df.write.parquet(f"{path}/route={n}")) for n in names}
    sinks.write_routed(t.events.select("event_id", "event_type"), C("event_type"), [("equals", "error", "alerts"), ("prefix", "p", "sales")], writers)
    return t.spark.read.parquet(path).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("k02_named_files", "SELECT 'logs_' || strftime(ts, '%Y%m%d') AS name, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    from flowspark.functions.text import name_from

    path = _folder(t)
    sinks.write_named_files(t.events.select("event_id", "ts"), path, name_from("logs_", "", "ts", "date"))
    return t.spark.read.json(path).groupBy(C("_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("d06_m20_fit_or_load", """
SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 2) AS label FROM lineitem,
  (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)""")
def _(t: Tables):
    path = _folder(t)
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_quantity").alias("x"), C("l_extendedprice").alias("y"))

    def fit(rows):
        return models.train_linear(rows, "x", "y", reg=0.0)

    def score(rows, model):
        return models.score_linear(rows, model, "x")

    models.fit_or_load(df, path, "price", fit, score)           # trains and stores
    out = models.fit_or_load(df, path, "price", fit, score)     # finds the stored model
    return out.select("l_orderkey", "l_linenumber", F.round("label", 2).alias("label"))
