"""Queries over text: tokens, signatures, patterns, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.catalog.base import Tables, query
from flowspark.functions import text as tx
from flowspark.operators import patterns as P
from flowspark.operators import textmining as M
from flowspark.operators import vectors as V

C = F.col


def _docs(t: Tables):
    return t.wide("documents", "doc_id", "text").select("doc_id", tx.split_tokens("text", r"\s+").alias("tokens"))


def _log_lines(t: Tables):
    """Log lines of one shape per event type."""
    line = F.concat(F.lit("user "), C("user_id").cast("string"), F.lit(" did "), C("event_type"), F.lit(" on item "),
                    (C("event_id") % 97).cast("string"), F.when(C("event_type") == "error", F.lit(" and failed with code "))
                    .otherwise(F.lit(" in ms: ")), F.floor("value").cast("string"))
    return t.wide("events", "event_id", "event_type", "user_id", "value").select("event_id", "event_type", line.alias("line"))


_DOCS = "WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS tokens FROM documents)\n"


@query("x01_split_tokens", _DOCS + "SELECT doc_id, len(tokens) AS n, tokens[1] AS first, tokens[-1] AS last FROM d")
def _(t: Tables):
    return _docs(t).select("doc_id", F.size("tokens").alias("n"), F.get("tokens", F.lit(0)).alias("first"),
                           F.try_element_at("tokens", F.lit(-1)).alias("last"))


@query("x02_log_tokens", r"""
SELECT page_id, len(regexp_extract_all(url, '([0-9A-Za-z]+|[^\x00-\x7f]+|[\x00-\x7f])', 1)) AS n,
       regexp_extract_all(url, '([0-9A-Za-z]+|[^\x00-\x7f]+|[\x00-\x7f])', 1) AS tokens FROM pages""")
def _(t: Tables):
    return t.pages.select("page_id", tx.log_tokens("url").alias("tokens")).select("page_id", F.size("tokens").alias("n"), "tokens")


@query("x03_minhash_signature")
def _(t: Tables):
    return M.minhash_signature(_docs(t), "doc_id", "tokens")


@query("x03_signature_of_a_set", _DOCS + "SELECT doc_id, true AS same FROM d WHERE len(tokens) > 0")
def _(t: Tables):
    """A signature belongs to the set of tokens: order and repetition leave it as it is."""
    docs = _docs(t)
    turned = docs.select("doc_id", F.concat(F.reverse("tokens"), F.slice("tokens", 1, 3)).alias("tokens"))
    other = M.minhash_signature(turned, "doc_id", "tokens").select("doc_id", C("sig_hi").alias("hi"), C("sig_lo").alias("lo"))
    both = M.minhash_signature(docs, "doc_id", "tokens").join(other, "doc_id")
    return both.select("doc_id", ((C("sig_hi") == C("hi")) & (C("sig_lo") == C("lo"))).alias("same"))


@query("x04_signature_distance", """
SELECT event_id, CAST(bit_count(xor(event_id * 40503, user_id * 97)) + bit_count(xor(event_id, user_id)) AS INTEGER) AS d,
       bit_count(xor(event_id * 40503, user_id * 97)) + bit_count(xor(event_id, user_id)) <= (1 - 0.95 + 0.05) * 128 AS near FROM events""")
def _(t: Tables):
    d = M.signature_distance(C("event_id") * 40503, C("event_id"), C("user_id") * 97, C("user_id"))
    return t.events.select("event_id", d.alias("d"), M.within(d, 0.95).alias("near"))


_ERROR_KEY = "'user*did error on item*and failed with code*'"


@query("x05_x06_log_patterns", f"""
SELECT CASE WHEN event_type = 'error' THEN {_ERROR_KEY} ELSE 'user*did*on item*in ms:*' END AS pattern_key,
       count(*) AS pattern_size, round(count(*) / (SELECT count(*) FROM events), 6) AS pattern_scale FROM events GROUP BY 1""")
def _(t: Tables):
    out = P.mine_patterns(_log_lines(t), "line", 0.95)
    return out.select("pattern_key", "pattern_size", F.round("pattern_scale", 6).alias("pattern_scale"))


@query("x07_match_patterns", f"""
SELECT event_id, true AS "isMatch", CASE WHEN event_type = 'error' THEN {_ERROR_KEY}
       ELSE 'user*did ' || event_type || ' on item*in ms:*' END AS "patternKey" FROM events""")
def _(t: Tables):
    lines = _log_lines(t)
    model = P.mine_patterns(lines, "line", 0.97)
    return P.match_patterns(lines, "line", model).select("event_id", "isMatch", "patternKey")


@query("x08_similar_clusters")
def _(t: Tables):
    return M.similar_clusters(_docs(t), "doc_id", "tokens", 0.7)


@query("x09_simhash", """
WITH tok AS (SELECT page_id, unnest(list_filter(string_split(url, '/'), lambda x: x <> '')) AS tk FROM pages),
h AS (SELECT page_id, xor(list_reduce(list_prepend((unicode(tk[1]) * 128) & 4294967295, list_transform(string_split(tk, ''), lambda c: CAST(unicode(c) AS BIGINT))),
        lambda x, c: xor(x * 1000003, c) & 4294967295), length(tk)) AS h FROM tok),
b AS (SELECT page_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, range(32) r(i) GROUP BY ALL)
SELECT page_id, string_agg(CASE WHEN v >= 0 THEN '1' ELSE '0' END, '' ORDER BY i DESC) AS bits FROM b GROUP BY page_id""")
def _(t: Tables):
    pages = t.pages.select("page_id", tx.split_tokens("url", "/").alias("tokens"))
    out = M.simhash(pages, "page_id", "tokens", 32)
    return out.select("page_id", F.array_join(F.transform("simhash", lambda x: x.cast("int").cast("string")), "").alias("bits"))


@query("x10_weighted_simhash")
def _(t: Tables):
    rows = V.tf_idf_rows(_docs(t), "doc_id", "tokens")
    return M.simhash(rows, "doc_id", "token", 32, "tf_idf")


@query("x11_hashing_tf", _DOCS + "SELECT doc_id, CAST(len(tokens) AS DOUBLE) AS mass FROM d")
def _(t: Tables):
    # the sparse vector has 2^20 slots; its total equals the number of tokens
    return V.hashing_tf(_docs(t), "tokens").select("doc_id", V.sparse_sum("tf").alias("mass"))


@query("x12_idf", _DOCS + """, p AS (SELECT DISTINCT doc_id, unnest(tokens) AS token FROM d)
SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)), 8) AS idf FROM p GROUP BY token""")
def _(t: Tables):
    return V.idf_table(_docs(t), "doc_id", "tokens").withColumn("idf", F.round("idf", 8))


@query("x13_tf_idf_rows", _DOCS + """, u AS (SELECT doc_id, unnest(tokens) AS token FROM d), tf AS (SELECT doc_id, token, count(*) AS tf FROM u GROUP BY ALL),
i AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)) AS idf FROM tf GROUP BY token)
SELECT doc_id, token, tf, round(tf * idf, 6) AS tf_idf FROM tf JOIN i USING (token)""")
def _(t: Tables):
    return V.tf_idf_rows(_docs(t), "doc_id", "tokens").withColumn("tf_idf", F.round("tf_idf", 6))


@query("x13_tf_idf_vector")
def _(t: Tables):
    return V.tf_idf(_docs(t), "tokens").select("doc_id", F.round(V.sparse_sum("vector"), 6).alias("mass"))


@query("x14_one_hot", """
SELECT event_id, list_transform(['click','error','purchase','signup','view'], lambda k: CASE WHEN k = event_type THEN 1 ELSE 0 END) AS hot FROM events""")
def _(t: Tables):
    from pyspark.ml.functions import vector_to_array

    out = V.one_hot(t.events.select("event_id", "event_type"), "event_type")
    values = F.transform(vector_to_array("vector"), lambda x: x.cast("int"))
    return out.select("event_id", F.slice(values, F.lit(1), F.lit(5)).alias("hot"))


@query("x15_date_slots", """
SELECT event_id, [month(ts) - 1, 12 + least((day(ts) - 1) // 7, 4), 17 + isodow(ts) - 1, 24 + hour(ts), 48 + minute(ts)] AS slots FROM events""")
def _(t: Tables):
    hot = V.date_slots("ts")
    at = F.filter(F.transform(hot, lambda x, i: F.when(x > 0, i)), lambda x: x.isNotNull())
    return t.events.select("event_id", at.alias("slots"))


@query("x16_scalar_columns", """
SELECT event_id, [round(atan(value) * 2 / pi(), 8), round(atan(user_id) * 2 / pi(), 8), 0.0] AS v FROM events""")
def _(t: Tables):
    df = t.events.select("event_id", "value", C("user_id").cast("string").alias("u"), "event_type")
    return df.select("event_id", F.transform(V.scalar_array(df, ["value", "u", "event_type"]), lambda x: F.round(x, 8)).alias("v"))


@query("x17_append_vector", """
SELECT vec_id, [embedding[1]::DOUBLE, embedding[64]::DOUBLE, label::DOUBLE] AS v FROM embeddings""")
def _(t: Tables):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = t.embeddings.select("vec_id", array_to_vector(F.array(C("embedding")[0].cast("double"), C("embedding")[63].cast("double"))).alias("vector"),
                             array_to_vector(F.array(C("label").cast("double"))).alias("more"))
    return V.append_vector(df, "vector", "more").select("vec_id", vector_to_array("vector").alias("v"))
