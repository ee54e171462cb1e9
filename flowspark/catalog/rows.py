"""Queries over single rows: rules, casts, parsers, scalar functions, output formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import Tables, query
from flowspark.functions import casts, dates, parse, text
from flowspark.operators import rules as R
from flowspark.sources import framing

C = F.col


def _line(cols: list[str], sep: str):
    """A delimited text line made from columns."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols])


# -- framing predicates ---------------------------------------------------------

@query("c04_match_lines", """
SELECT doc_id, line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE regexp_matches(line, '^[A-Z][a-z]+ .*\\.$')""")
def _(t: Tables):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return framing.keep_matching(lines, "line", r"^[A-Z][a-z]+ .*\.$")


@query("c07_record_filters", """
SELECT p_partkey, p_name,
       starts_with(p_name, 'small') AS starts, ends_with(p_name, 'ring') AS ends,
       regexp_full_match(p_type, 'ECO.*|PROMO') AS matches, contains(p_brand, '#1') AS contains_1
FROM part
WHERE starts_with(p_name, 'small') OR ends_with(p_name, 'ring')
   OR regexp_full_match(p_type, 'ECO.*|PROMO') OR contains(p_brand, '#1')""")
def _(t: Tables):
    tests = {
        "starts": framing.record_filter("prefix", "p_name", "small"),
        "ends": framing.record_filter("suffix", "p_name", "ring"),
        "matches": framing.record_filter("match", "p_type", "ECO.*|PROMO"),
        "contains_1": framing.record_filter("contain", "p_brand", "#1"),
    }
    df = t.part.withColumns(tests)
    return df.where("starts OR ends OR matches OR contains_1").select("p_partkey", "p_name", *tests)


# -- parsers ----------------------------------------------------------------------

@query("p01_raw", "SELECT props AS raw FROM events")
def _(t: Tables):
    return parse.parse(t.events.select("props"), "props", parse.raw()).select("raw")


@query("p02_transfer", "SELECT event_id, user_id, event_type, props AS raw FROM events")
def _(t: Tables):
    df = t.events.select("event_id", "user_id", "event_type", "props")
    return parse.parse(df, "props", parse.transfer()).drop("_raw", "_error")


@query("p03_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS error FROM events""")
def _(t: Tables):
    df = t.events.select("event_id", "props")
    schema = parse.json_schema_of(df, "props")
    out = parse.parse(df, "props", parse.json(schema))
    return out.select("event_id", "k", C("_error").alias("error"))


@query("p05_grok_url", """
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
       regexp_extract(url, '://([^/:?#]+)', 1) AS host,
       nullif(regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1), '') AS path
FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/:?#]+')""")
def _(t: Tables):
    shape = r"^%{PROTO:scheme}://%{SITE:host}(?:%{WAY:path})?"
    library = {"PROTO": "[a-z]+", "SITE": "[^/:?#]+", "WAY": "/[^?#]*"}
    out = parse.parse(t.pages.select("page_id", "url"), "url", parse.regex(shape, library))
    return out.where("_error IS NULL").select("page_id", "scheme", "host", "path")


@query("p05_p14_grok_event_time", """
SELECT event_id, epoch_ms(date_trunc('second', ts)) AS ms, event_type AS verb, user_id AS bytes FROM events""")
def _(t: Tables):
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    line = F.concat(F.lit("10.0.0.1 - - ["), stamp, F.lit(' +0000] "'), C("event_type"), F.lit(' /x HTTP/1.1" 200 '), C("user_id").cast("string"))
    out = parse.parse(t.events.select("event_id", line.alias("line")), "line", parse.regex("%{COMMONAPACHELOG}", time_parts=True))
    ms = F.unix_millis(dates.captured_time([c for c in out.columns if c.startswith("_")], F.lit("2100-01-01 00:00:00")))
    return out.select("event_id", ms.alias("ms"), "verb", C("bytes").cast("long").alias("bytes"))


@query("p06_delimited", """
SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS part, l_returnflag AS flag,
       l_linestatus || ',' || strftime(l_shipdate, '%Y-%m-%d') AS rest
FROM lineitem""")
def _(t: Tables):
    df = t.wide("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate").withColumn("line", F.concat_ws(
        ",", C("l_partkey").cast("string"), C("l_returnflag"), C("l_linestatus"),
        F.date_format("l_shipdate", "yyyy-MM-dd")))
    out = parse.parse(df.select("l_orderkey", "l_linenumber", "line"), "line",
                      parse.delimited(",", ["part", "flag", "rest"]))
    return out.select("l_orderkey", "l_linenumber", "part", "flag", "rest")


@query("p07_key_value", """
SELECT event_id, CAST(user_id AS VARCHAR) AS usr, event_type AS type, 'a b, c' AS note,
       CASE WHEN user_id % 2 = 0 THEN event_type END AS src_even FROM events""")
def _(t: Tables):
    line = F.concat(F.lit("usr="), C("user_id").cast("string"), F.lit(',type="'), C("event_type"),
                    F.lit("\",note='a b, c',src,even="),
                    F.when(C("user_id") % 2 == 0, C("event_type")).otherwise("N/A"))
    df = t.wide("events", "event_id", "event_type", "user_id").select("event_id", line.alias("line"))
    out = parse.parse(df, "line", parse.key_value(",", "=", ["usr", "type", "note", "src_even"]))
    return out.drop("_raw", "_error")


@query("p08_cef", """
SELECT event_id, '0' AS version, 'acme' AS device_vendor, event_type AS name, CAST(user_id % 10 AS VARCHAR) AS severity,
       CAST(user_id AS VARCHAR) AS suser, 'seen ' || event_type || ' today' AS msg FROM events""")
def _(t: Tables):
    line = F.concat(F.lit("CEF:0|acme|gate|1.0|100|"), C("event_type"), F.lit("|"),
                    (C("user_id") % 10).cast("string"), F.lit("|suser="), C("user_id").cast("string"),
                    F.lit(" msg=seen "), C("event_type"), F.lit(" today"))
    out = parse.parse(t.wide("events", "event_id", "event_type", "user_id").select("event_id", line.alias("line")), "line", parse.cef())
    return out.select("event_id", "version", "device_vendor", "name", "severity",
                      C("extension")["suser"].alias("suser"), C("extension")["msg"].alias("msg"))


@query("p09_select_parser", """
SELECT event_id, CASE WHEN user_id % 3 = 2 THEN NULL ELSE event_type END AS kind,
       CASE WHEN user_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END AS usr, user_id % 3 = 2 AS failed
FROM events""")
def _(t: Tables):
    line = F.when(C("user_id") % 3 == 0, F.concat(F.lit("u="), C("user_id").cast("string"), F.lit(" t="), C("event_type"))) \
        .when(C("user_id") % 3 == 1, F.concat(F.lit("["), C("event_type"), F.lit("]"))).otherwise(F.lit("??"))
    parser = parse.select([parse.regex(r"^u=%{INT:usr} t=%{WORD:kind}$"), parse.regex(r"^\[%{WORD:kind}\]$")])
    out = parse.parse(t.events.select("event_id", line.alias("line")), "line", parser)
    return out.select("event_id", "kind", "usr", C("_error").isNotNull().alias("failed"))


@query("p10_chain_parser", """
SELECT event_id, CAST(user_id AS VARCHAR) AS usr, event_type AS kind FROM events""")
def _(t: Tables):
    line = F.concat(F.lit("u="), C("user_id").cast("string"), F.lit(" t="), C("event_type"))
    parser = parse.chain([parse.regex(r"u=%{INT:usr} t=%{NOTSPACE:kind}"), parse.regex(r"t=%{WORD:kind}$")])
    out = parse.parse(t.events.select("event_id", line.alias("line")), "line", parser)
    return out.select("event_id", "usr", "kind")


@query("p11_failures_kept", """
SELECT count(*) FILTER (WHERE value < 100) AS good, count(*) FILTER (WHERE value >= 100) AS bad,
       CAST(sum(CASE WHEN value >= 100 THEN length(CAST(user_id AS VARCHAR)) ELSE 0 END) AS BIGINT) AS bad_chars FROM events""")
def _(t: Tables):
    line = F.when(C("value") < 100, F.concat(F.lit("id="), C("user_id").cast("string"))).otherwise(C("user_id").cast("string"))
    out = parse.parse(t.events.select(line.alias("line")), "line", parse.regex("^id=%{INT:id}$"))
    is_bad = C("_error").isNotNull()
    return out.agg(F.count_if(~is_bad).alias("good"), F.count_if(is_bad).alias("bad"),
                   F.sum(F.when(is_bad, F.length("_raw")).otherwise(0)).alias("bad_chars"))


@query("p12_flatten", """
SELECT event_id, '{"id":' || user_id || ',"kind":"' || event_type || '"}' AS usr,
       user_id AS "usr.id", event_type AS "usr.kind" FROM events""")
def _(t: Tables):
    nested = t.events.select("event_id", F.struct(C("user_id").alias("id"), C("event_type").alias("kind")).alias("usr"))
    return parse.flatten(nested)


@query("p13_properties", """
SELECT 'k' AS key, 'bigint' AS type, min(CAST(json_extract(props, '$.k') AS VARCHAR)) AS sample, 1.0 AS filled FROM events""")
def _(t: Tables):
    df = t.events.select("props")
    parsed = parse.parse(df, "props", parse.json(parse.json_schema_of(df, "props")))
    return parse.properties(parsed.select("k"))


@query("p15_reparse", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS props_event_type FROM events""")
def _(t: Tables):
    df = t.events.select("event_id", "event_type", F.concat(
        F.rtrim(F.regexp_replace("props", r"\}$", "")), F.lit(', "event_type":"'), C("event_type"), F.lit('"}')).alias("props"))
    step = parse.reparse("props", parse.json("k bigint, event_type string"), [R.remove_fields(["raw", "_error"])])
    return df.transform(step)


# -- rules ----------------------------------------------------------------------

@query("r01_add_fields", """
SELECT event_id, event_type, 'seen-' || event_type || '!' AS msg, event_type AS copy, 'x' AS pre_event_type, 'fixed' AS label
FROM events""")
def _(t: Tables):
    rule = R.add_fields({"msg": "seen-%{event_type}!", "copy": "%{event_type}", "pre_%{event_type}": "x",
                         "%{event_type}": "never", "gone": "%{no_such}", "label": "fixed"})
    return t.events.select("event_id", "event_type").transform(rule)


@query("r02_add_tags", "SELECT event_id, event_type, event_type AS tag_event_type FROM events")
def _(t: Tables):
    return t.events.select("event_id", "event_type").transform(
        R.add_tags(["tag_%{event_type}", "plain", "%{event_type}", "x_%{missing}"]))


@query("r03_remove_fields", "SELECT event_id, event_type AS kind FROM events")
def _(t: Tables):
    df = t.events.select("event_id", "value", F.struct("user_id", C("event_type").alias("kind")).alias("n"))
    return df.transform(R.remove_fields(["value", "n.user_id", "absent"])).select("event_id", C("n.kind").alias("kind"))


@query("r04_remove_tags", "SELECT event_id, event_type FROM events")
def _(t: Tables):
    df = t.events.select("event_id", "event_type").transform(R.add_tags(["tag_%{event_type}"]))
    return df.transform(R.remove_tags(["tag_%{event_type}"]))


@query("r05_mapping", "SELECT event_id, user_id AS usr, event_type AS kind FROM events")
def _(t: Tables):
    df = t.events.select("event_id", C("user_id"), F.struct("event_type").alias("n"))
    return df.transform(R.mapping({"user_id": "usr", "n.event_type": "kind"}))


@query("r06_merger", "SELECT event_id, coalesce(event_type,'') || '|' || CAST(user_id AS VARCHAR) || '|' AS merged FROM events")
def _(t: Tables):
    return t.events.transform(R.merger(["event_type", "user_id", "missing"], "merged", "|")).select("event_id", "merged")


@query("r07_replace", "SELECT event_id, user_id, regexp_replace(props, '[0-9]+', event_type, 'g') AS props FROM events")
def _(t: Tables):
    return t.events.select("event_id", "user_id", "event_type", "props").transform(
        R.replace("props", "[0-9]+", "%{event_type}")).drop("event_type")


@query("r08_cut", """
SELECT event_id, CASE WHEN length(event_type) < 2 THEN event_type ELSE substr(event_type, 3, 3) END AS a,
       CASE WHEN length(props) < 20 THEN props ELSE substr(props, 21, 3) END AS b,
       CASE WHEN length(event_type) < 5 THEN event_type ELSE left(event_type, length(event_type) - 5) END AS c FROM events""")
def _(t: Tables):
    df = t.events.select("event_id", C("event_type").alias("a"), C("props").alias("b"), C("event_type").alias("c"))
    return R.apply_rules(df, [R.field_cut("a", 2, 3), R.field_cut("b", 20, 3), R.field_cut("c", -1, 5)])


@query("r09_multiply", """
SELECT event_id, round(value * 3, 4) AS value, user_id * 3 AS user_id,
       CASE WHEN user_id % 2 = 0 THEN CAST(user_id * 3 AS VARCHAR) WHEN user_id % 3 = 0 THEN '0' ELSE event_type END AS mixed
FROM events""")
def _(t: Tables):
    mixed = F.when(C("user_id") % 2 == 0, C("user_id").cast("string")).when(C("user_id") % 3 == 0, F.lit("")).otherwise(C("event_type"))
    df = t.events.select("event_id", "value", "user_id", mixed.alias("mixed"))
    df = R.apply_rules(df, [R.field_multiply("value", 3), R.field_multiply("user_id", 3), R.field_multiply("mixed", 3)])
    return df.withColumn("value", F.round("value", 4))


@query("r10_add_constant", """
SELECT event_id, round(value + 13, 4) AS value,
       CASE WHEN user_id % 2 = 0 THEN CAST(user_id + 13 AS VARCHAR) WHEN user_id % 3 = 0 THEN '13' ELSE event_type END AS mixed
FROM events""")
def _(t: Tables):
    mixed = F.when(C("user_id") % 2 == 0, C("user_id").cast("string")).when(C("user_id") % 3 == 0, F.lit("")).otherwise(C("event_type"))
    df = t.events.select("event_id", "value", mixed.alias("mixed"))
    df = R.apply_rules(df, [R.field_add("value", 13), R.field_add("mixed", 13)])
    return df.withColumn("value", F.round("value", 4))


@query("r11_extends", """
SELECT doc_id, unnest(list_filter(string_split(source || ',' || lang, ','), lambda x: x <> '')) AS part FROM documents""")
def _(t: Tables):
    df = t.documents.select("doc_id", text.split_tokens(F.concat_ws(",", "source", "lang"), ",").alias("part"))
    return df.transform(R.extends("part"))


@query("r12_list_to_map", "SELECT doc_id, source AS first, lang AS second FROM documents")
def _(t: Tables):
    df = t.documents.select("doc_id", F.array("source", "lang", "source").alias("m")).transform(
        R.list_to_map("m", ["first", "second"]))
    return df.select("doc_id", C("m")["first"].alias("first"), C("m")["second"].alias("second"))


@query("r13_drop", "SELECT event_id FROM events WHERE NOT coalesce(event_type = 'error', false)")
def _(t: Tables):
    return t.events.transform(R.drop_rows(C("event_type") == "error")).select("event_id")


@query("r14_mark_error", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad kind' END AS error FROM events""")
def _(t: Tables):
    df = t.events.transform(R.mark_error("bad kind", C("event_type") == "error")).transform(R.ignore())
    return df.select("event_id", C("_error").alias("error"))


def _switched(t: Tables, kind: str, cases, subject="event_type"):
    rules = [(value, [R.add_fields({"level": level})]) for value, level in cases]
    df = t.events.select("event_id", "event_type", "user_id", "value")
    return df.transform(R.switch(subject, rules, [R.add_fields({"level": "rest"})], kind)).select("event_id", "level")


@query("r15_switch_equals", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'money' ELSE 'rest' END AS level FROM events""")
def _(t: Tables):
    return _switched(t, "equals", [("error", "high"), ("purchase", "money")])


@query("r16_switch_prefix", """
SELECT event_id, CASE WHEN starts_with(event_type,'p') THEN 'p' WHEN starts_with(event_type,'s') THEN 's' ELSE 'rest' END AS level FROM events""")
def _(t: Tables):
    return _switched(t, "prefix", [("p", "p"), ("s", "s"), ("pur", "never")])


@query("r17_switch_suffix", """
SELECT event_id, CASE WHEN ends_with(event_type,'up') THEN 'up' WHEN ends_with(event_type,'w') THEN 'w' ELSE 'rest' END AS level FROM events""")
def _(t: Tables):
    return _switched(t, "suffix", [("up", "up"), ("w", "w")])


@query("r18_switch_match", """
SELECT event_id, CASE WHEN regexp_full_match(event_type,'c.*k') THEN 'ck' WHEN regexp_full_match(event_type,'.{4}') THEN 'four' ELSE 'rest' END AS level FROM events""")
def _(t: Tables):
    return _switched(t, "match", [("c.*k", "ck"), (".{4}", "four")])


@query("r19_switch_contain", """
SELECT event_id, CASE WHEN contains(event_type,'rr') THEN 'rr' WHEN contains(event_type,'i') THEN 'i' ELSE 'rest' END AS level FROM events""")
def _(t: Tables):
    return _switched(t, "contain", [("rr", "rr"), ("i", "i")])


@query("r20_switch_computed", """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'zero' WHEN user_id % 3 = 1 THEN 'one' ELSE 'rest' END AS level FROM events""")
def _(t: Tables):
    return _switched(t, "equals", [("0", "zero"), ("1", "one")], F.expr("user_id % 3"))


@query("r21_script", """
SELECT event_id, upper(event_type) AS loud, round(value * 2 + user_id, 4) AS score FROM events""")
def _(t: Tables):
    rule = R.script({"loud": "upper(event_type)", "score": "round(value * 2 + user_id, 4)"})
    return t.events.transform(rule).select("event_id", "loud", "score")


@query("r22_rule_list", """
SELECT event_id, unnest(string_split('a,b', ',')) AS part, 'k-' || event_type AS tag FROM events WHERE event_type <> 'view'""")
def _(t: Tables):
    df = t.events.select("event_id", "event_type").withColumn("part", F.split(F.lit("a,b"), ","))
    return R.apply_rules(df, [
        R.drop_rows(C("event_type") == "view"), R.add_fields({"tag": "k-%{event_type}"}),
        R.extends("part"), R.remove_fields(["event_type"])])


@query("r23_numeric_text", """
SELECT event_id, CASE WHEN user_id % 3 = 2 THEN NULL ELSE (CASE WHEN user_id % 3 = 0 THEN 10000.0 ELSE 1.0 END) * user_id END AS n FROM events""")
def _(t: Tables):
    raw = F.when(C("user_id") % 3 == 0, F.concat(C("user_id").cast("string"), F.lit("万"))) \
        .when(C("user_id") % 3 == 1, C("user_id").cast("string")).otherwise(C("event_type"))
    return t.events.select("event_id", text.numeric_text(raw).alias("n"))


@query("r24_capture_groups", """
SELECT page_id, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page,
       nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS host FROM pages""")
def _(t: Tables):
    rule = R.capture("url", ["[?&]page=(?<page>[0-9]+)", "^https?://(?<host>[^/?#]+)"], every=True)
    return t.pages.transform(rule).select("page_id", "page", "host")


@query("r25_xpath", """
SELECT event_id, event_type AS kind, [CAST(user_id AS VARCHAR), event_type] AS items FROM events""")
def _(t: Tables):
    xml = F.concat(F.lit("<r><k> "), C("event_type"), F.lit(" </k><i>"), C("user_id").cast("string"),
                   F.lit("</i><i>"), C("event_type"), F.lit("</i></r>"))
    rule = R.xpath_fields("xml", {"kind": ("/r/k/text()", False), "items": ("/r/i/text()", True)})
    return t.wide("events", "event_id", "event_type", "user_id").select("event_id", xml.alias("xml")).transform(rule).drop("xml")


@query("r26_xml_to_text", "SELECT event_id, event_type || chr(10) || CAST(user_id AS VARCHAR) AS body FROM events")
def _(t: Tables):
    xml = F.concat(F.lit("<r><k>"), C("event_type"), F.lit("</k><i>"), C("user_id").cast("string"), F.lit("</i></r>"))
    return t.wide("events", "event_id", "event_type", "user_id").select("event_id", xml.alias("xml")).transform(R.xml_to_text("xml", ["k", "i"], "body")).drop("xml")


@query("r27_stable_id", """
SELECT event_id, upper(md5(event_type || '-' || CAST(user_id AS VARCHAR))) AS id2, event_type AS id1 FROM events""")
def _(t: Tables):
    df = t.events.select("event_id", "event_type", "user_id")
    df = R.apply_rules(df, [R.stable_id(["event_type", "user_id"], "id2"), R.stable_id(["event_type"], "id1")])
    return df.select("event_id", "id2", "id1")


# -- casts ------------------------------------------------------------------------

@query("n01_normalize", """
SELECT event_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id AS INTEGER) END AS n,
       CASE WHEN user_id % 4 = 0 THEN 'n is no integer' END AS error,
       CASE WHEN user_id % 4 = 0 THEN event_type END AS kept FROM events""")
def _(t: Tables):
    raw = F.when(C("user_id") % 4 == 0, C("event_type")).otherwise(C("user_id").cast("string"))
    df = casts.normalize(t.events.select("event_id", raw.alias("n")), [("n", "integer")])
    return df.select("event_id", "n", C("_error").alias("error"), C("_rejected")["n"].alias("kept"))


@query("n02_whole_from_text", """
SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS price, CAST(l_quantity AS INTEGER) AS qty FROM lineitem""")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             casts.to_whole(F.format_string("%.2f", "l_extendedprice"), "long").alias("price"),
                             casts.to_whole(F.format_string("%.1f", "l_quantity"), "integer").alias("qty"))


@query("n03_real_from_text", "SELECT l_orderkey, l_linenumber, l_discount AS discount, round(l_tax * 100, 6) AS tax FROM lineitem")
def _(t: Tables):
    short = F.regexp_replace(F.format_string("%.2f", "l_discount"), r"^0\.", ".")
    sci = F.concat(F.format_string("%.2f", C("l_tax")), F.lit("E2"))
    return t.lineitem.select("l_orderkey", "l_linenumber", casts.to_real(short).alias("discount"),
                             F.round(casts.to_real(sci), 6).alias("tax"))


@query("n04_boolean", """
SELECT event_id, CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM events""")
def _(t: Tables):
    raw = F.when(C("user_id") % 3 == 0, F.lit("TRUE")).when(C("user_id") % 3 == 1, F.lit("0")).otherwise(F.lit("maybe"))
    return t.events.select("event_id", casts.to_bool(raw).alias("flag"))


@query("n05_byte_and_text", """
SELECT event_id, CASE WHEN user_id <= 127 THEN CAST(user_id AS TINYINT) END AS b, '{"t":"' || event_type || '"}' AS s FROM events""")
def _(t: Tables):
    df = t.events.select("event_id", C("user_id").alias("b"), F.struct(C("event_type").alias("t")).alias("s"))
    return casts.normalize(df, [("b", "byte"), ("s", "string")]).select("event_id", "b", "s")


@query("n06_dates", """
SELECT event_id, epoch_ms(date_trunc('second', ts)) AS from_text, epoch_us(ts) // 1000 AS from_ms FROM events""")
def _(t: Tables):
    ts = C("ts").cast("timestamp")
    from_text = casts.to_moment(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss")
    from_ms = casts.to_moment(F.unix_millis(ts), "", numeric=True)
    return t.events.select("event_id", F.unix_millis(from_text).alias("from_text"), F.unix_millis(from_ms).alias("from_ms"))


@query("n07_list_cast", "SELECT event_id, [CAST(user_id AS INTEGER), NULL, 2] AS xs FROM events")
def _(t: Tables):
    return t.events.select("event_id", casts.cast_to(F.array(C("user_id").cast("string"), F.lit("x"), F.lit("1.5")),
                                                      "list[integer]").alias("xs"))


@query("n08_ip_to_long", """
SELECT event_id, CASE WHEN user_id % 5 = 0 THEN -1 ELSE 10*16777216 + (user_id % 256)*65536 + 7*256 + event_id % 250 END AS ip FROM events""")
def _(t: Tables):
    ip = F.concat_ws(".", F.when(C("user_id") % 5 == 0, F.lit("300")).otherwise(F.lit("10")),
                     (C("user_id") % 256).cast("string"), F.lit("7"), (C("event_id") % 250).cast("string"))
    return t.events.select("event_id", casts.ip_to_long(ip).alias("ip"))


# -- scalar functions -----------------------------------------------------------------

@query("f01_like", """
SELECT p_partkey, contains(p_name,'ing') AS both_, ends_with(p_name,'ring') AS left_, starts_with(p_name,'red') AS right_, p_type = 'ECONOMY' AS none_ FROM part""")
def _(t: Tables):
    return t.part.select("p_partkey", text.like("p_name", "%ing%").alias("both_"), text.like("p_name", "%ring").alias("left_"),
                         text.like("p_name", "red%").alias("right_"), text.like("p_type", "ECONOMY").alias("none_"))


@query("f02_f03_long_date", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, epoch_ms(o_orderdate) AS ms FROM orders""")
def _(t: Tables):
    ms = dates.date_to_long("o_orderdate")
    return t.orders.select("o_orderkey", dates.long_to_date(ms).cast("string").alias("d"), ms.alias("ms"))


@query("f04_parse_moment", """
SELECT event_id, CASE user_id % 3 WHEN 0 THEN epoch_ms(date_trunc('second', ts)) WHEN 1 THEN epoch_ms(date_trunc('day', ts)) END AS ms FROM events""")
def _(t: Tables):
    ts = C("ts").cast("timestamp")
    raw = F.when(C("user_id") % 3 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")) \
        .when(C("user_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.lit("no date"))
    return t.events.select("event_id", F.unix_millis(dates.parse_moment(raw)).alias("ms"))


@query("f05_f06_starts", """
SELECT event_id, epoch_ms(date_trunc('day', ts)) AS day_ms, epoch_ms(date_trunc('day', ts) + INTERVAL 1 DAY) AS next_ms,
       CAST(epoch_ms(date_trunc('minute', ts)) // 1000 AS BIGINT) AS minute_s, epoch_ms(date_trunc('hour', ts)) AS hour_ms FROM events""")
def _(t: Tables):
    ms = F.unix_millis(C("ts").cast("timestamp"))
    return t.events.select("event_id", dates.day_start(ms).alias("day_ms"), dates.next_day_start(ms).alias("next_ms"),
                           dates.minute_start(ms, "S").alias("minute_s"), dates.hour_start(ms).alias("hour_ms"))


@query("f07_f08_calendar", """
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_first,
       strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_last,
       strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m-%d') AS prev_first,
       strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d') AS prev_last,
       CAST(month(o_orderdate) AS INTEGER) AS m, CAST(year(o_orderdate) AS INTEGER) AS y,
       strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday, CAST(weekofyear(o_orderdate) AS INTEGER) AS w FROM orders""")
def _(t: Tables):
    d = C("o_orderdate")
    return t.orders.select(
        "o_orderkey", dates.month_first(d).cast("string").alias("month_first"),
        dates.last_day_of(F.year(d), F.month(d)).cast("string").alias("month_last"),
        dates.previous_month_first(d).cast("string").alias("prev_first"),
        dates.previous_month_last(d).cast("string").alias("prev_last"),
        F.month(d).alias("m"), F.year(d).alias("y"), dates.week_first(d).cast("string").alias("monday"), F.weekofyear(d).alias("w"))


@query("f09_f10_text_dates", """
SELECT o_orderkey, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS yesterday, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS tomorrow,
       strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%d') AS before30, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS later30,
       strftime(o_orderdate, '%d/%m/%Y') AS slashed, epoch_ms(o_orderdate) AS ms, strftime(o_orderdate, '%Y%m%d') AS compact,
       CAST(NULL AS VARCHAR) AS bad FROM orders""")
def _(t: Tables):
    fmt = "yyyy-MM-dd"
    day = F.date_format("o_orderdate", fmt)
    ms = dates.text_to_epoch(day, fmt)
    return t.orders.select(
        "o_orderkey", dates.shifted_text(day, fmt, -1).alias("yesterday"), dates.shifted_text(day, fmt, 1).alias("tomorrow"),
        dates.shifted_text(day, fmt, -30).alias("before30"), dates.shifted_text(day, fmt, 30).alias("later30"),
        dates.reformat(day, fmt, "dd/MM/yyyy").alias("slashed"), ms.alias("ms"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("compact"),
        dates.reformat(F.concat(F.lit("x"), day), fmt, "dd").alias("bad"))


@query("f11_f12_distances", """
SELECT o_orderkey, epoch_ms(date_trunc('day', o_orderdate) - INTERVAL 7 DAY) AS back7,
       CAST((year(DATE '2003-03-15') - year(o_orderdate)) * 12 + 3 - month(o_orderdate) + 1 AS INTEGER) AS months,
       CAST((2003 - year(o_orderdate)) * 52 + weekofyear(DATE '2003-03-15') - weekofyear(o_orderdate) + 1 AS INTEGER) AS weeks,
       epoch_ms(o_orderdate - INTERVAL 90 MINUTE) AS minutes_ago,
       CAST(date_diff('second', o_orderdate, TIMESTAMP '2003-03-15 00:00:00') AS BIGINT) AS secs FROM orders""")
def _(t: Tables):
    d = C("o_orderdate").cast("timestamp")
    end = F.to_timestamp(F.lit("2003-03-15 00:00:00"))
    return t.orders.select(
        "o_orderkey", F.unix_millis(dates.days_back(d, 7)).alias("back7"),
        dates.months_between_inclusive(d, end).alias("months"), dates.weeks_between_inclusive(d, end).alias("weeks"),
        F.unix_millis(dates.minutes_shift(d, -90)).alias("minutes_ago"), dates.seconds_between(d, end).alias("secs"))


@query("f13_f14_quoted_text", """
SELECT event_id, [event_type, '"a,b"', '(x,y)'] AS pieces, event_type || ';"a,b"' AS replaced FROM events""")
def _(t: Tables):
    line = F.concat(C("event_type"), F.lit(',"a,b",(x,y)'))
    short = F.concat(C("event_type"), F.lit(',"a,b"'))
    return t.events.select("event_id", text.split_outside_quotes_and_brackets(line, ",").alias("pieces"),
                           text.replace_outside_quotes(short, ",", ";").alias("replaced"))


@query("f15_typed_text", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts, CAST(o_custkey AS VARCHAR) AS n FROM orders""")
def _(t: Tables):
    return t.orders.select("o_orderkey", text.to_text("o_orderdate", "date").alias("d"),
                           text.to_text("o_orderdate", "timestamp").alias("ts"), text.to_text("o_custkey", "bigint").alias("n"))


@query("f16_squash", "SELECT event_id, round(atan(value) * 2 / pi(), 8) AS s FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.round(text.squash("value"), 8).alias("s"))


@query("f17_name_templates", """
SELECT event_id, 'logs_' || event_type AS by_value, 'logs_' || strftime(ts, '%Y%m%d') || '.log' AS by_date,
       'l_' || substr(event_type, 1, 3) AS by_start, 'l_' || right(event_type, 3) AS by_end, 'l_default' AS missing FROM events""")
def _(t: Tables):
    return t.events.select(
        "event_id", text.name_from("logs_", "", "event_type").alias("by_value"),
        text.name_from("logs_", ".log", "ts", "date").alias("by_date"),
        text.name_from("l_", "", "event_type", "truncate", start=0, length=3).alias("by_start"),
        text.name_from("l_", "", "event_type", "truncate", side="end", start=0, length=3).alias("by_end"),
        text.name_from("l_", "", F.lit(None)).alias("missing"))


@query("f17_hash_names")
def _(t: Tables):
    return t.events.select(text.name_from("part_", "", "user_id", "mod", mod=10).alias("name")).groupBy("name").count()


@query("f17_hash_names_hold", "SELECT user_id, 1 AS names, count(*) AS n, true AS in_range FROM events GROUP BY user_id")
def _(t: Tables):
    """One name per value, out of the ten the template allows."""
    named = t.events.select("user_id", text.name_from("part_", "", "user_id", "mod", mod=10).alias("name"))
    return named.groupBy("user_id").agg(F.count_distinct("name").alias("names"), F.count(F.lit(1)).alias("n"),
                                        F.min(C("name").rlike("^part_[0-9]$")).alias("in_range"))


@query("f18_column_case", 'SELECT event_id AS "EventId", event_type AS "eventType" FROM events')
def _(t: Tables):
    from flowspark.plans.sql import run_sql

    view = t.events.select(C("event_id").alias("EventId"), C("event_type").alias("eventType"))
    return run_sql({"Log": view}, "SELECT EVENTID, EVENTTYPE FROM log")
