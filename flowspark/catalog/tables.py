"""Queries over whole tables: lookups, joins, aggregates, order, sets, merges, output text."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import Tables, query
from flowspark.functions import casts, parse
from flowspark.operators import aggregates as A
from flowspark.operators import enrich, joins, upsert
from flowspark.operators import rules as R
from flowspark.plans import branch
from flowspark.plans.scale import carry, first_per_key, ordered
from flowspark.plans.sql import register_functions, run_sql
from flowspark.sources import sinks

C = F.col


# -- the flagship ------------------------------------------------------------------

@query("flagship_event_windows", """
SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS w_start, c_mktsegment AS segment,
       CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'money' ELSE 'rest' END AS level,
       count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, round(sum(value), 2) AS v_sum
FROM events LEFT JOIN customer ON user_id = c_custkey GROUP BY ALL""")
def _(t: Tables):
    df = parse.parse(t.wide("events", "ts", "user_id", "event_type", "value", "props"), "props", parse.json("k string"))
    df = R.apply_rules(df, [
        R.switch("event_type", [("error", [R.add_fields({"level": "high"})]), ("purchase", [R.add_fields({"level": "money"})])],
                 [R.add_fields({"level": "rest"})]),
        R.remove_fields(["raw", "_raw", "event_type"])])
    df = casts.normalize(df, [("k", "long")])
    df = enrich.lookup(df, t.customer.select("c_custkey", "c_mktsegment"), "user_id", "c_custkey", ["c_mktsegment"])
    out = A.tumbling(df, "ts", "1 hour", ["c_mktsegment", "level"], n=F.count(F.lit(1)), k_sum=F.sum("k"),
                     v_sum=F.round(F.sum("value"), 2))
    return out.select(F.unix_millis("w_start").alias("w_start"), C("c_mktsegment").alias("segment"), "level", "n", "k_sum", "v_sum")


# -- lookups ---------------------------------------------------------------------------

def _ranges(t: Tables):
    """An address range table made from the parts: one block of 4096 addresses per part."""
    lo = F.lit(184549376) + C("p_partkey") * 4096
    return t.part.select(lo.alias("lo"), (lo + 4095).alias("hi"), C("p_brand").alias("city"), C("p_type").alias("company"))


@query("n09_ip_location", """
WITH e AS (SELECT event_id, user_id % 7 = 0 AS private, 184549376 + (event_id * 977) % (SELECT 4096 * (count(*) + 50) FROM part) AS n FROM events)
SELECT event_id, CASE WHEN NOT private THEN p_brand END AS city, CASE WHEN NOT private THEN p_type END AS company
FROM e LEFT JOIN part ON p_partkey = (n - 184549376) // 4096""")
def _(t: Tables):
    span = (t.part.count() + 50) * 4096
    number = F.lit(184549376) + (C("event_id") * 977) % span
    ip = F.when(C("user_id") % 7 == 0, F.lit("10.0.0.8")).otherwise(casts.long_to_ip(number))
    df = t.events.select("event_id", ip.alias("ip"))
    out = enrich.ip_location(df, "ip", _ranges(t), "lo", "hi")
    return out.select("event_id", C("ip_city").alias("city"), C("ip_company").alias("company"))


@query("n09_ip_own_dictionary", """
SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'own' WHEN user_id < (SELECT count(*) FROM part) THEN p_brand END AS city
FROM events LEFT JOIN part ON p_partkey = user_id""")
def _(t: Tables):
    ip = F.when(C("user_id") % 7 == 0, F.lit("10.0.0.8")).otherwise(casts.long_to_ip(F.lit(184549376) + C("user_id") * 4096 + 5))
    own = t.region.where("r_regionkey = 0").select(F.lit("10.0.0.8").alias("ip"), F.lit("own").alias("city"))
    df = t.events.select("event_id", ip.alias("ip"))
    return enrich.ip_location(df, "ip", _ranges(t), "lo", "hi", own).select("event_id", C("ip_city").alias("city"))


@query("n10_region_by_prefix", """
SELECT c_custkey, n_name AS id_name FROM customer LEFT JOIN nation
  ON n_nationkey + 100000 = 100000 + c_custkey % 30""")
def _(t: Tables):
    ids = t.customer.select("c_custkey", F.concat((F.lit(100000) + C("c_custkey") % 30).cast("string"), F.lit("19900101001X")).alias("id"))
    regions = t.nation.select((C("n_nationkey") + 100000).alias("code"), C("n_name").alias("name"))
    return enrich.region_by_prefix(ids, "id", regions, "code").select("c_custkey", "id_name")


@query("n11_dictionary", """
SELECT event_id, user_id, c_name AS user_id_c_name, c_acctbal AS user_id_c_acctbal FROM events LEFT JOIN customer ON user_id = c_custkey""")
def _(t: Tables):
    return enrich.dictionary(t.events.select("event_id", "user_id"), t.customer.select("c_custkey", "c_name", "c_acctbal"),
                             "user_id", "c_custkey")


@query("n12_lookup", """
WITH one AS (SELECT o_custkey, min((o_orderkey, o_orderstatus)) AS r FROM orders GROUP BY 1)
SELECT event_id, user_id, event_type, r[1] AS o_orderkey, r[2] AS event_type_user_id FROM events LEFT JOIN one ON user_id = o_custkey""")
def _(t: Tables):
    table = t.orders.select("o_custkey", "o_orderkey", C("o_orderstatus").alias("event_type"))
    return enrich.lookup(t.events.select("event_id", "user_id", "event_type"), table, "user_id", "o_custkey", ["o_orderkey"])


@query("n13_condition_lookup", """
WITH h AS (SELECT l.o_orderkey AS id, s.p_partkey, s.p_retailprice, s.p_brand
           FROM orders l JOIN part s ON l.o_custkey % 50 + 1 = s.p_size AND s.p_retailprice < l.o_totalprice / 100)
SELECT o_orderkey, p_brand, p_partkey FROM orders LEFT JOIN
  (SELECT id, max((p_retailprice, -p_partkey, p_brand)) AS m, max((p_retailprice, -p_partkey, p_brand))[3] AS p_brand,
          -(max((p_retailprice, -p_partkey, p_brand))[2]) AS p_partkey FROM h GROUP BY id) ON id = o_orderkey""")
def _(t: Tables):
    df = t.orders.select("o_orderkey", "o_totalprice", (C("o_custkey") % 50 + 1).cast("int").alias("p_size"))
    table = t.part.select("p_size", "p_partkey", "p_brand", "p_retailprice", (-C("p_retailprice")).alias("_down"))
    out = enrich.condition_lookup(df, table, "p_retailprice < o_totalprice / 100", ["_down", "p_partkey"], "o_orderkey", ["p_size"],
                                  below=("p_retailprice", "o_totalprice / 100"))
    return out.select("o_orderkey", "p_brand", "p_partkey")


@query("n14_reference_table", """
SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(t: Tables):
    dim = enrich.cached_dimension(t.region)
    return enrich.lookup(t.nation, dim, "n_regionkey", "r_regionkey").select("n_name", "r_name")


@query("n15_fill_missing", """
SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 0 ELSE value END AS zero,
  round(CASE WHEN user_id % 5 = 0 THEN (SELECT avg(value) FROM events WHERE user_id % 5 <> 0) ELSE value END, 6) AS mean FROM events""")
def _(t: Tables):
    gap = F.when(C("user_id") % 5 != 0, C("value"))
    df = t.events.select("event_id", gap.alias("zero"), gap.alias("mean"))
    df = enrich.fill_missing(df, ["zero"])
    return enrich.fill_missing(df, ["mean"], "avg").withColumn("mean", F.round("mean", 6))


# -- joins -------------------------------------------------------------------------------

@query("s10_first_match", """
WITH one AS (SELECT o_custkey, min((o_orderdate, o_orderkey)) AS r FROM orders GROUP BY 1)
SELECT c_custkey, c_name, r[2] AS o_orderkey FROM customer LEFT JOIN one ON c_custkey = o_custkey""")
def _(t: Tables):
    out = joins.first_match(t.customer.select("c_custkey", "c_name"), t.orders.select("o_custkey", "o_orderkey", "o_orderdate"),
                            [("c_custkey", "o_custkey")], ["o_orderdate", "o_orderkey"])
    return out.select("c_custkey", "c_name", "o_orderkey")


@query("j01_text_key_join", """
WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1000 <> 0 THEN o_custkey END AS ck FROM orders),
     r AS (SELECT CASE WHEN c_custkey <> 3 THEN c_custkey END AS ck2, c_name FROM customer)
SELECT o_orderkey, ck2, c_name FROM l JOIN r ON coalesce(CAST(ck AS VARCHAR), '') = coalesce(CAST(ck2 AS VARCHAR), '')""")
def _(t: Tables):
    left = t.orders.select("o_orderkey", F.when(C("o_orderkey") % 1000 != 0, C("o_custkey")).alias("ck"), F.lit("old").alias("c_name"))
    right = t.customer.select(F.when(C("c_custkey") != 3, C("c_custkey").cast("int")).alias("ck2"), "c_name")
    return joins.text_key_join(left, right, [("ck", "ck2")]).drop("ck")


@query("j02_join_with", """
SELECT o_orderkey, c_name || '/' || o_orderstatus AS tag, round(o_totalprice + c_acctbal, 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t: Tables):
    return joins.join_with(t.orders, t.customer, [("o_custkey", "c_custkey")], {
        "o_orderkey": "l.o_orderkey", "tag": "concat(r.c_name, '/', l.o_orderstatus)",
        "total": "round(l.o_totalprice + r.c_acctbal, 2)"})


@query("j10_label_pairs", """
WITH d AS (SELECT DISTINCT label FROM embeddings) SELECT a.label AS first, b.label AS second FROM d a JOIN d b ON a.label <= b.label""")
def _(t: Tables):
    return joins.label_pairs(t.embeddings, "label")


@query("j11_group_means", """
SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_returnflag, l_linestatus), 6) AS mean_qty FROM lineitem""")
def _(t: Tables):
    df = joins.with_group_means(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity"),
                                ["l_returnflag", "l_linestatus"], ["l_quantity"])
    return df.select("l_orderkey", "l_linenumber", F.round("mean_l_quantity", 6).alias("mean_qty"))


@query("j12_aligned", """
WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS v FROM events GROUP BY ALL)
SELECT a.event_type, epoch_ms(a.day) AS day_ms, round(a.v, 6) AS actual, round(b.v, 6) AS predicted
FROM d a JOIN d b ON a.event_type = b.event_type AND a.day = b.day + INTERVAL 1 DAY""")
def _(t: Tables):
    days = t.events.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("v"))
    ahead = days.select("event_type", (C("day") + F.expr("INTERVAL 1 DAY")).alias("day"), C("v").alias("p"))
    out = joins.aligned(ahead, days, ["event_type", "day"])
    return out.select("event_type", F.unix_millis(C("day").cast("timestamp")).alias("day_ms"),
                      F.round("v", 6).alias("actual"), F.round("p", 6).alias("predicted"))


_J13 = """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(c_custkey) AS known
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_tax > 0.07)
GROUP BY o_orderpriority"""


@query("j13_sql_joins", _J13)
def _(t: Tables):
    return run_sql({"orders": t.orders, "customer": t.customer, "lineitem": t.lineitem}, _J13)


_J13B = """
SELECT n.n_name, s.s_name, p.size_class FROM nation n FULL JOIN supplier s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 5000
LEFT JOIN (SELECT p_partkey, p_size // 10 AS size_class FROM part) p ON p.p_partkey = s.s_suppkey"""


@query("j13_sql_full_join", _J13B)
def _(t: Tables):
    return run_sql({"nation": t.nation, "supplier": t.supplier, "part": t.part}, _J13B.replace("//", "div"))


# -- aggregates ---------------------------------------------------------------------------

@query("a01_sql_case", """
SELECT event_type AS "eventType", sum(user_id) AS total FROM events WHERE contains(event_type, 'i') GROUP BY event_type""")
def _(t: Tables):
    view = t.events.select(C("event_type").alias("eventType"), "user_id")
    return run_sql({"log": view}, "SELECT EVENTTYPE, sum(USER_ID) AS total FROM log WHERE eventtype LIKE '%i%' GROUP BY EVENTTYPE")


_A02 = """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
       round(avg(l_discount), 8) AS mean_disc FROM lineitem WHERE l_shipdate <= DATE '2001-09-01' GROUP BY l_returnflag, l_linestatus"""


@query("a02_group_aggregates", _A02)
def _(t: Tables):
    return t.lineitem.where("l_shipdate <= DATE '2001-09-01'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"), F.round(F.avg("l_discount"), 8).alias("mean_disc"))


_RANK_SQL = """
WITH s AS (SELECT {key} AS k, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {table}),
b AS (SELECT *, CAST(ceil((n - 1) * ({p} - 0.01)) AS BIGINT) AS lo, CAST(floor(n * ({p} + 0.01)) AS BIGINT) AS hi FROM s)
SELECT k AS {key}, round(avg(v), 6) AS percent_rank FROM b
WHERE CASE WHEN lo = hi THEN i = hi WHEN hi - lo = 1 AND hi >= n THEN i = lo WHEN hi - lo = 1 THEN i IN (lo, hi) ELSE i > lo AND i < hi END
GROUP BY k"""


@query("a03_percent_rank", _RANK_SQL.format(key="event_type", value="value", table="events", p=0.9))
def _(t: Tables):
    return A.percent_rank_mean(t.events, ["event_type"], "value", 0.9).withColumn("percent_rank", F.round("percent_rank", 6))


@query("y02_percent_rank_many_keys", _RANK_SQL.format(key="l_suppkey", value="l_extendedprice", table="lineitem", p=0.5))
def _(t: Tables):
    return A.percent_rank_mean(t.lineitem, ["l_suppkey"], "l_extendedprice", 0.5).withColumn("percent_rank", F.round("percent_rank", 6))


@query("a04_count", "SELECT count(*) AS n FROM lineitem")
def _(t: Tables):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


@query("a05_distinct", "SELECT DISTINCT p_brand FROM part")
def _(t: Tables):
    return t.part.select("p_brand").distinct()


@query("a06_series_per_key", """
WITH d AS (SELECT event_type, date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY ALL)
SELECT event_type, list(round(v, 6) ORDER BY h) AS series FROM d GROUP BY event_type""")
def _(t: Tables):
    out = A.series_per_key(t.events, ["event_type"], "ts", "value", "hour")
    return out.select("event_type", F.transform("series", lambda x: F.round(x, 6)).alias("series"))


@query("a07_tumbling", """
SELECT epoch_ms(time_bucket(INTERVAL 5 MINUTE, ts)) AS w_start, epoch_ms(time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE) AS w_end,
       event_type, count(*) AS n, sum(user_id) AS users FROM events GROUP BY ALL""")
def _(t: Tables):
    out = A.tumbling(t.events, "ts", "5 minutes", ["event_type"], n=F.count("user_id"), users=F.sum("user_id"))
    return out.withColumns({"w_start": F.unix_millis("w_start"), "w_end": F.unix_millis("w_end")})


@query("a08_channel_counts", """
SELECT 'read' AS phase, count(*) AS "in", count(*) FILTER (WHERE event_type <> 'error') AS success,
       count(*) FILTER (WHERE event_type = 'error') AS fail, 0 AS ignore FROM events""")
def _(t: Tables):
    df = t.events.transform(R.mark_error("bad", C("event_type") == "error"))
    error = C("_error").isNotNull()
    return df.agg(F.count(F.lit(1)).alias("in"), F.count_if(~error).alias("success"), F.count_if(error).alias("fail")) \
        .select(F.lit("read").alias("phase"), "in", "success", "fail", F.lit(0).alias("ignore"))


@query("a09_roll_up", """
WITH u AS (SELECT event_type, date_trunc('day', ts) AS slot, value, min((ts, event_id)) AS r FROM events GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type, slot ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type, slot) AS n FROM u)
SELECT event_type, epoch_ms(slot) AS slot_ms, value, r[2] AS event_id FROM p WHERE n <= 2 OR i IN (1, (n - 1) // 2 + 1, n)""")
def _(t: Tables):
    out = A.roll_up(t.events.select("event_type", "ts", "value", "event_id"), "event_type", "ts", "value", "1 day")
    return out.select("event_type", F.unix_millis("slot").alias("slot_ms"), "value", "event_id")


@query("a10_choose_level", """
SELECT CASE WHEN count(*) > 5000 THEN 'hour' WHEN count(*) <= 100 THEN 'second' ELSE 'minute' END AS level
FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-08'""")
def _(t: Tables):
    from datetime import datetime

    level = A.choose_level(t.events, "ts", datetime(2024, 1, 2), datetime(2024, 1, 8), 100, 5000)
    return t.events.agg(F.max(F.lit(level)).alias("level"))


@query("a11_thin_out", """
WITH e AS (SELECT event_type, event_id, epoch_us(ts) // 1000 AS ms FROM events), r AS (SELECT min(ms) AS a, max(ms) - min(ms) AS w FROM e),
l1 AS (SELECT e.*, a, w // 3 AS w1 FROM e, r), d1 AS (SELECT *, least((ms - a) // w1, 2) AS g1 FROM l1),
d2 AS (SELECT *, a + g1 * w1 AS a2, w1 // 3 AS w2 FROM d1), d3 AS (SELECT *, least((ms - a2) // w2, 2) AS g2 FROM d2),
d4 AS (SELECT *, a2 + g2 * w2 AS a3, w2 // 3 AS w3 FROM d3), d5 AS (SELECT *, least((ms - a3) // w3, 2) AS g3 FROM d4),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type, g1, g2, g3 ORDER BY ms) AS i, count(*) OVER (PARTITION BY event_type, g1, g2, g3) AS n FROM d5)
SELECT event_type, event_id FROM p WHERE i = n // 2 + 1""")
def _(t: Tables):
    return A.thin_out(t.events.select("event_type", "event_id", "ts"), "event_type", "ts", 20, 100).select("event_type", "event_id")


@query("a12_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def _(t: Tables):
    from datetime import datetime

    return A.retain_after(t.events, "ts", datetime(2024, 1, 10)).select("event_id")


# -- order, samples, sets --------------------------------------------------------------------

@query("w01_row_index", "SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS idx FROM events")
def _(t: Tables):
    return A.row_index(t.events.select("event_id", "ts"), ["ts"], "idx").select("event_id", "idx")


@query("w02_half_split", """
SELECT part, count(*) AS n, sum(event_id) AS ids FROM (
  SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts) - 1 <= floor(count(*) OVER () / 2) THEN 'train' ELSE 'test' END AS part FROM events)
GROUP BY part""")
def _(t: Tables):
    train, test = A.half_split(t.events.select("event_id", "ts"), ["ts"])
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


_W03 = """
SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place,
       round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 2) AS running FROM customer"""


@query("w03_over", _W03)
def _(t: Tables):
    df = t.customer.select("c_custkey", "c_nationkey", "c_acctbal", (-C("c_acctbal")).alias("_down"))
    keys = ["c_nationkey"]
    placed = ordered(df, keys, ["_down", "c_custkey"]).select("c_custkey", "c_nationkey", "c_acctbal", C("_pos").alias("place"))
    out = carry(ordered(placed, keys, ["c_custkey"]), keys, {"running": ("c_acctbal", "sum")})
    return out.select("c_custkey", "place", F.round("running", 2).alias("running"))


@query("w04_first_per_key", """
SELECT p_brand, r[2] AS p_partkey, r[3] AS p_name FROM (SELECT p_brand, min((-length(p_name), p_partkey, p_name)) AS r FROM part GROUP BY 1)""")
def _(t: Tables):
    df = t.part.select("p_brand", "p_partkey", "p_name")
    return first_per_key(df, ["p_brand"], [-F.length("p_name"), "p_partkey"])


@query("t01_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(C("o_totalprice").desc(), "o_orderkey").limit(25)


@query("t02_samples")
def _(t: Tables):
    train, test = t.lineitem.randomSplit([0.6, 0.4], seed=2000)
    half = t.lineitem.sample(False, 0.5, 2000)
    parts = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
             for name, df in (("train", train), ("test", test), ("half", half))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("t02_split_facts", """
SELECT count(*) AS n_all, 0 AS n_astray, 0 AS n_outside, true AS near_share FROM lineitem""")
def _(t: Tables):
    """The two parts of a split together are the table, no row more or less; a sample holds rows of the table only."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber")
    train, test = rows.randomSplit([0.6, 0.4], seed=2000)
    marked = train.withColumn("part", F.lit(1)).unionByName(test.withColumn("part", F.lit(2))).unionByName(
        rows.sample(False, 0.5, 2000).withColumn("part", F.lit(0))).unionByName(rows.withColumn("part", F.lit(4)))
    each = marked.groupBy("l_orderkey", "l_linenumber").agg(*[F.sum((C("part") == k).cast("long")).alias(f"p{k}") for k in (0, 1, 2, 4)])
    share = F.abs(F.sum("p1") / F.sum("p4") - 0.6) < 0.05
    return each.agg(F.sum(C("p1") + C("p2")).alias("n_all"), F.sum(F.abs(C("p1") + C("p2") - C("p4"))).alias("n_astray"),
                    F.sum(((C("p0") > 0) & (C("p4") == 0)).cast("long")).alias("n_outside"), share.alias("near_share"))


_U01 = """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 48
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3"""


@query("u01_union_all", _U01)
def _(t: Tables):
    return run_sql({"lineitem": t.lineitem}, _U01)


@query("u02_union_by_name", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(t: Tables):
    return t.customer.select(C("c_custkey").alias("k"), C("c_name").alias("name")).unionByName(
        t.supplier.select(C("s_name").alias("name"), C("s_suppkey").alias("k")))


@query("u03_complement", "SELECT event_id FROM events WHERE NOT (event_type = 'error' OR starts_with(event_type, 'p'))")
def _(t: Tables):
    return A.complement(t.events, "event_type", [C("event_type") == "error", C("event_type").startswith("p")]).select("event_id")


_U04 = "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"
_U04B = "SELECT user_id % 40 AS k FROM events EXCEPT ALL SELECT c_custkey FROM customer"


@query("u04_intersect", _U04)
def _(t: Tables):
    return run_sql({"customer": t.customer, "supplier": t.supplier}, _U04)


@query("u04_except_all", _U04B)
def _(t: Tables):
    return run_sql({"events": t.events, "customer": t.customer}, _U04B)


@query("y01_sql_functions", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, epoch_us(ts) // 1000 AS ms, contains(event_type, 'i') AS hit FROM events""")
def _(t: Tables):
    register_functions(t.spark)
    view = t.events.select("event_id", C("ts").cast("timestamp").alias("ts"), "event_type")
    return run_sql({"log": view}, """SELECT event_id, CAST(Long2Date(Date2Long(ts)) AS STRING) AS d, Date2Long(ts) AS ms,
                                            LikeEnds(event_type, '%i%') AS hit FROM log""")


@query("y03_fan_out", "SELECT event_id, unnest(string_split(event_type, 'i')) AS piece FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.explode(F.split("event_type", "i")).alias("piece"))


# -- branches ---------------------------------------------------------------------------------

@query("d01_branches", """
SELECT 'p' AS branch, event_id FROM events WHERE starts_with(event_type, 'p')
UNION ALL SELECT 'pur', event_id FROM events WHERE starts_with(event_type, 'pur')
UNION ALL SELECT 'none', event_id FROM events WHERE NOT starts_with(event_type, 'p')""")
def _(t: Tables):
    out = branch.branch_union(t.events, "event_type", [("p",), ("pur",)], "prefix", "_b")
    name = F.element_at(F.array(F.lit("p"), F.lit("pur"), F.lit("none")), C("_b") + 1)
    return out.select(name.alias("branch"), "event_id")


@query("d02_branch_predicates", """
SELECT kind, count(*) AS n FROM (
  SELECT 'equals' AS kind FROM events WHERE event_type = 'view' UNION ALL SELECT 'suffix' FROM events WHERE ends_with(event_type, 'up')
  UNION ALL SELECT 'match' FROM events WHERE regexp_full_match(event_type, '.{5}') UNION ALL SELECT 'contain' FROM events WHERE contains(event_type, 'rr')
  UNION ALL SELECT 'script' FROM events WHERE user_id % 2 = 1) GROUP BY kind""")
def _(t: Tables):
    tests = [("equals", "view", "event_type"), ("suffix", "up", "event_type"), ("match", ".{5}", "event_type"), ("contain", "rr", "event_type")]
    arms = [F.when(branch.branch_conditions(C(c), [(v,)], k)[0], F.lit(k)) for k, v, c in tests]
    arms.append(F.when(branch.branch_conditions(F.expr("user_id % 2"), [("1",)])[0], F.lit("script")))
    kinds = F.filter(F.array(*arms), lambda x: x.isNotNull())
    return t.events.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("d03_branch_analyzer", """
SELECT event_type, round(sum(value), 2) AS total FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type
UNION ALL SELECT 'rest', round(sum(value), 2) FROM events WHERE event_type NOT IN ('click', 'view')""")
def _(t: Tables):
    total = branch.analyzer(lambda df: df.groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total")))
    rest = branch.analyzer(lambda df: df.agg(F.round(F.sum("value"), 2).alias("total")).withColumn("event_type", F.lit("rest")))
    a, b, c = branch.branches(t.events, "event_type", [("click", total), ("view", total)], rest)
    return a.unionByName(b).unionByName(c).select("event_type", "total")


@query("d04_branch_parser", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'kind-' || event_type AS tag FROM events WHERE event_type = 'click'""")
def _(t: Tables):
    step = branch.parser_step("props", parse.json("k bigint"), [R.add_fields({"tag": "kind-%{event_type}"})])
    return branch.branches(t.events, "event_type", [("click", step)])[0].select("event_id", "k", "tag")


@query("d05_channel_tree", """
SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1""")
def _(t: Tables):
    tree = branch.Analyzed(
        branch.Joined(branch.Source("orders", [R.drop_rows("o_orderstatus = 'P'")]), branch.Source("customer"), [("o_custkey", "c_custkey")]),
        lambda df: df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")))
    return branch.build(tree, {"orders": t.orders, "customer": t.customer})


@query("d07_pass_through", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t: Tables):
    return t.nation.transform(branch.none_step())


# -- output text and routing ---------------------------------------------------------------------

@query("k01_routes", """
SELECT CASE WHEN event_type = 'error' THEN 'alerts' WHEN starts_with(event_type, 'p') THEN 'sales'
            WHEN regexp_full_match(event_type, '.*k') THEN 'web' ELSE 'default' END AS route, count(*) AS n FROM events GROUP BY 1""")
def _(t: Tables):
    rules = [("equals", "error", "alerts"), ("prefix", "p", "sales"), ("match", ".*k", "web")]
    return t.events.select(sinks.route_of(C("event_type"), rules).alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("k04_json_text", """
SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '"' ||
       CASE WHEN user_id % 2 = 0 THEN ',"u":' || user_id ELSE '' END || '}' AS line FROM events""")
def _(t: Tables):
    df = t.events.select("event_id", "event_type", F.when(C("user_id") % 2 == 0, C("user_id")).alias("u"))
    return df.select(sinks.json_text(df).alias("line"))


@query("k05_xml_text", """
SELECT '<event_id>' || event_id || '</event_id><props>' || props || '</props>' AS line FROM events""")
def _(t: Tables):
    df = t.events.select("event_id", "props")
    return df.select(sinks.xml_text(df).alias("line"))


@query("k06_delimited_text", """
SELECT event_id || ',' || CASE WHEN user_id % 2 = 0 THEN '''a,b''' ELSE event_type END || ',''' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ''',' AS line FROM events""")
def _(t: Tables):
    df = t.events.select("event_id", F.when(C("user_id") % 2 == 0, F.lit("a,b")).otherwise(C("event_type")).alias("x"), "ts",
                         F.lit(None).cast("string").alias("none"))
    return df.select(sinks.delimited_text(df, ",").alias("line"))


@query("k07_key_value_text", """
SELECT 'event_id=' || event_id || ' x=' || CASE WHEN user_id % 2 = 0 THEN '''a b''' ELSE event_type END AS line FROM events""")
def _(t: Tables):
    df = t.events.select("event_id", F.when(C("user_id") % 2 == 0, F.lit("a b")).otherwise(C("event_type")).alias("x"),
                         F.lit(None).cast("string").alias("none"))
    return df.select(sinks.key_value_text(df, " ", "=").alias("line"))


@query("k08_syslog_text", """
SELECT '<' || (16 * 8 + user_id % 8) || '>' || strftime(ts, '%b %d %H:%M:%S') || ' web' || user_id || ' [' || event_type || '] ' || props AS line FROM events""")
def _(t: Tables):
    host = F.concat(F.lit("web"), C("user_id").cast("string"))
    return t.events.select(sinks.syslog_text(C("props"), C("ts"), host, C("event_type"), 16, C("user_id") % 8).alias("line"))


# -- merges -----------------------------------------------------------------------------------------

@query("k11_merge_partial", """
WITH b AS (SELECT o_custkey AS c_custkey, max((o_orderdate, o_orderkey, o_orderstatus)) AS r FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT coalesce(c.c_custkey, b.c_custkey) AS c_custkey, c_name, coalesce(r[3], CASE WHEN c.c_custkey % 2 = 0 THEN 'old' END) AS status
FROM (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0) c FULL JOIN b ON b.c_custkey = c.c_custkey""")
def _(t: Tables):
    stored = t.customer.where("c_acctbal > 0").select(
        "c_custkey", "c_name", F.when(C("c_custkey") % 2 == 0, F.lit("old")).alias("status"))
    batch = t.orders.where("o_orderstatus <> 'P'").select(
        C("o_custkey").alias("c_custkey"), C("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    return upsert.merge_partial(stored, batch, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "c_name", "status")


@query("k12_merge_add", """
WITH b AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, k) AS k, coalesce(c_nationkey, 0) + coalesce(n, 0) AS n FROM customer FULL JOIN b ON c_custkey = k""")
def _(t: Tables):
    stored = t.customer.select(C("c_custkey").alias("k"), C("c_nationkey").cast("long").alias("n"))
    return upsert.merge_add(stored, t.orders.select(C("o_custkey").alias("k"), F.lit(1).alias("n")), ["k"], ["n"])


@query("k13_merge_children", """
WITH old AS (SELECT o_orderkey, 99 AS id, 'old' AS flag FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 1, 'old' FROM orders WHERE o_orderkey % 2 = 0),
new AS (SELECT l_orderkey, l_linenumber, max((l_partkey, l_suppkey, l_shipdate, l_returnflag))[4] AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
al AS (SELECT o_orderkey, id, flag, true AS kept FROM old WHERE (o_orderkey, id) NOT IN (SELECT (l_orderkey, l_linenumber) FROM new)
       UNION ALL SELECT l_orderkey, l_linenumber, flag, false FROM new)
SELECT o_orderkey, list(id || flag ORDER BY kept DESC, CASE WHEN kept THEN -id ELSE id END) AS children FROM al GROUP BY o_orderkey""")
def _(t: Tables):
    kid = "struct<id:int,flag:string>"
    old = F.array(F.struct(F.lit(99).alias("id"), F.lit("old").alias("flag")), F.struct(F.lit(1).alias("id"), F.lit("old").alias("flag")))
    parents = t.orders.select("o_orderkey", F.when(C("o_orderkey") % 2 == 0, old).cast(f"array<{kid}>").alias("children"))
    children = t.lineitem.select(C("l_orderkey").alias("o_orderkey"), C("l_linenumber").alias("id"), C("l_returnflag").alias("flag"),
                                 "l_partkey", "l_suppkey", "l_shipdate")
    latest = upsert.last_per_key(children, ["o_orderkey", "id"], ["l_partkey", "l_suppkey", "l_shipdate", "flag"]).select("o_orderkey", "id", "flag")
    out, _ = upsert.merge_children(parents, latest, "o_orderkey", "id", "children", ["id"])
    return out.where("children IS NOT NULL").select("o_orderkey", F.transform("children", lambda x: F.concat(x.id.cast("string"), x.flag)).alias("children"))
