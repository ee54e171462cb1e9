"""Queries that train and score models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from flowspark.catalog.base import Tables, query
from flowspark.operators import hmm, models
from flowspark.operators.dbscan import dbscan

C = F.col


def _priced(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount", "l_tax").alias("x"),
                             C("l_extendedprice").alias("y"))


@query("m01_linear_regression", """
SELECT 1 AS size, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 2) AS w0 FROM lineitem""")
def _(t: Tables):
    df = t.lineitem.select(F.array("l_quantity").alias("x"), C("l_extendedprice").alias("y"))
    model = models.train_linear(df, "x", "y", reg=0.0)
    return model.select("size", F.round("intercept", 2).alias("intercept"), F.round(C("data")[0], 2).alias("w0"))


@query("m01_train_test_errors")
def _(t: Tables):
    train, test = models.train_test(_priced(t))
    model = models.train_linear(train, "x", "y")
    scored = models.score_linear(test, model, "x", "p")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(C("y") - C("p"), 2))).alias("rmse"), F.stddev("y").alias("spread"))


@query("m02_squared_residuals", """
WITH m AS (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT round(sum((l_extendedprice - a - b * l_quantity) ** 2) / count(*), 2) AS mse FROM lineitem, m""")
def _(t: Tables):
    df = t.lineitem.select(F.array("l_quantity").alias("x"), C("l_extendedprice").alias("y"))
    model = models.train_linear(df, "x", "y", reg=0.0, solver="l-bfgs", max_iter=200, tol=1e-12)
    n = df.count()
    return models.squared_residuals(df, model, "x", "y").select(F.round(C("ssr") / n, 2).alias("mse"))


@query("m03_polynomial", """
SELECT l_orderkey, l_linenumber, round(l_quantity + l_quantity ** 2 + l_tax + l_tax * l_quantity + l_tax ** 2, 6) AS total FROM lineitem""")
def _(t: Tables):
    from pyspark.ml.functions import vector_to_array

    df = t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_tax").alias("x"))
    out = models.polynomial(df, "x", 2)
    total = F.aggregate(vector_to_array("poly"), F.lit(0.0), lambda a, x: a + x)
    return out.select("l_orderkey", "l_linenumber", F.round(total, 6).alias("total"))


@query("m04_score_linear", "SELECT l_orderkey, l_linenumber, round(10 + 2 * l_quantity - 3 * l_discount + 0.5 * l_tax, 6) AS label FROM lineitem")
def _(t: Tables):
    model = t.spark.createDataFrame([(10.0, "dense", 3, [2.0, -3.0, 0.5])], models.LINEAR)
    out = models.score_linear(_priced(t), model, "x")
    return out.select("l_orderkey", "l_linenumber", F.round("label", 6).alias("label"))


@query("m05_dbscan", """
WITH p AS (SELECT o_totalprice AS x, min(o_orderkey) AS id FROM orders GROUP BY 1),
c AS (SELECT x, id, count(*) OVER (ORDER BY x RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING) AS n FROM p),
k AS (SELECT x, id, CASE WHEN x - lag(x) OVER (ORDER BY x) <= 60 THEN 0 ELSE 1 END AS s FROM c WHERE n >= 6),
g AS (SELECT x, id, sum(s) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS g FROM k),
r AS (SELECT g, dense_rank() OVER (ORDER BY min(id)) AS label, min(x) AS lo, max(x) AS hi FROM g GROUP BY g),
l AS (SELECT x, label FROM g JOIN r USING (g)
      UNION ALL SELECT c.x, min(r.label) FROM c JOIN g ON g.x BETWEEN c.x - 60 AND c.x + 60 JOIN r ON r.g = g.g WHERE c.n < 6 GROUP BY c.x)
SELECT o_orderkey, CAST(label AS INTEGER) AS label FROM orders JOIN l ON o_totalprice = l.x""")
def _(t: Tables):
    return dbscan(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"], 60.0, 6, "o_orderkey").select("o_orderkey", "label")


@query("m05_dbscan_two_fields")
def _(t: Tables):
    df = t.customer.select("c_custkey", (C("c_acctbal") / 1000).alias("a"), C("c_nationkey").cast("double").alias("b"))
    return dbscan(df, ["a", "b"], 0.4, 6, "c_custkey").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("m06_dbscan_strict", """
WITH p AS (SELECT value AS x, min(event_id) AS id FROM events GROUP BY 1),
c AS (SELECT x, id, count(*) OVER (ORDER BY x RANGE BETWEEN 0.045 PRECEDING AND 0.045 FOLLOWING) - 1 AS n FROM p),
k AS (SELECT x, id, CASE WHEN x - lag(x) OVER (ORDER BY x) < 0.045 THEN 0 ELSE 1 END AS s FROM c WHERE n >= 7),
g AS (SELECT x, id, sum(s) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS g FROM k),
r AS (SELECT g, dense_rank() OVER (ORDER BY min(id)) AS label FROM g GROUP BY g),
l AS (SELECT x, label FROM g JOIN r USING (g)
      UNION ALL SELECT c.x, min(r.label) FROM c JOIN g ON g.x BETWEEN c.x - 0.045 AND c.x + 0.045 JOIN r ON r.g = g.g WHERE c.n < 7 GROUP BY c.x)
SELECT event_id, CAST(label AS INTEGER) AS label FROM events JOIN l ON value = l.x""")
def _(t: Tables):
    # values lie on a grid of 0.01, so a strict and an inclusive bound of 0.045 agree
    df = t.events.select("event_id", "value")
    return dbscan(df, ["value"], 0.045, 7, "event_id", inclusive=False, count_self=False).select("event_id", "label")


def _centroids(t: Tables, k: int = 4):
    rows = t.embeddings.orderBy("vec_id").limit(k).select("embedding").collect()
    return [list(map(float, r[0])) for r in rows]


@query("m07_kmeans_step", """
WITH c AS (SELECT vec_id AS i, embedding::DOUBLE[64] AS e FROM embeddings ORDER BY vec_id LIMIT 4),
d AS (SELECT v.vec_id, v.embedding, arg_min(c.i, array_distance(v.embedding::DOUBLE[64], c.e)) AS cluster FROM embeddings v, c GROUP BY ALL)
SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS n, round(avg(embedding[1]::DOUBLE), 5) AS m0, round(avg(embedding[64]::DOUBLE), 5) AS m63 FROM d GROUP BY 1""")
def _(t: Tables):
    out = models.assign(t.embeddings, "embedding", np.array(_centroids(t)))
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(C("embedding")[0].cast("double")), 5).alias("m0"),
                                      F.round(F.avg(C("embedding")[63].cast("double")), 5).alias("m63"))


def _kmeans_sql(rounds: int) -> str:
    """The rounds one after the other: nearest centre, then the mean of every place."""
    steps = ["c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, embedding::DOUBLE[] AS e FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 4))"]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT v.vec_id, v.embedding::DOUBLE[] AS v, arg_min(c.k, list_distance(v.embedding::DOUBLE[], c.e)) AS k "
                     f"FROM embeddings v, c{r} c GROUP BY ALL)")
        steps.append(f"c{r + 1} AS (SELECT k, list(m ORDER BY i) AS e FROM (SELECT k, i, avg(x) AS m FROM "
                     f"(SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY k, i) GROUP BY k)")
    return f"WITH {', '.join(steps)} SELECT CAST(k AS INTEGER) AS cluster, count(*) AS n FROM a{rounds} GROUP BY k"


@query("m07_kmeans_rounds", _kmeans_sql(5))
def _(t: Tables):
    centres = models.kmeans(t.embeddings, "embedding", _centroids(t), 5)
    return models.assign(t.embeddings, "embedding", centres).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("m08_svm_two_classes")
def _(t: Tables):
    df = t.embeddings.select("embedding", F.when(C("label") < 5, "low").otherwise("high").alias("label"))
    model = models.train_svm(df, "embedding", "label")
    return models.score_svm(df.withColumnRenamed("label", "truth"), model, "embedding").groupBy("truth", "label").agg(F.count(F.lit(1)).alias("n"))


@query("m09_m10_svm_many_classes")
def _(t: Tables):
    df = t.embeddings.select("vec_id", "embedding", (C("label") % 3).alias("kind"))
    model = models.train_svm(df, "embedding", "kind", max_iter=20)
    return models.score_svm(df, model, "embedding").groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))


@query("m10_svm_score", """
SELECT vec_id, CASE WHEN embedding[1]::DOUBLE * 2 - embedding[2]::DOUBLE > 0.05 THEN 'yes' ELSE 'no' END AS label FROM embeddings""")
def _(t: Tables):
    model = t.spark.createDataFrame([("yes", "no", 0.05, [2.0, -1.0] + [0.0] * 62, 0, 0.0)], models.SVM)
    return models.score_svm(t.embeddings.select("vec_id", "embedding"), model, "embedding").select("vec_id", "label")


@query("m11_logistic_regression")
def _(t: Tables):
    df = t.documents.join(t.labels, "doc_id").select(F.array(F.log1p("n_chars"), F.size(F.split("text", " ")).cast("double")).alias("x"), "quality")
    fitted = models.train_logistic(df, "x", "quality")
    scored = models.score_logistic(df, fitted, "x")
    return scored.groupBy("quality", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("m12_generalized_linear", """
SELECT round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 1) AS w0 FROM lineitem""")
def _(t: Tables):
    df = t.lineitem.select(F.array("l_quantity").alias("x"), C("l_extendedprice").alias("y"))
    fitted = models.train_glm(df, "x", "y")
    return t.lineitem.agg(F.round(F.max(F.lit(float(fitted.intercept))), 1).alias("intercept"),
                          F.round(F.max(F.lit(float(fitted.coefficients[0]))), 1).alias("w0"))


@query("m13_m15_pca_variance", """
SELECT round(sum(v), 6) AS total FROM (SELECT var_samp(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) r(i) GROUP BY i)""")
def _(t: Tables):
    model = models.train_pca(t.embeddings, "embedding", k=64)
    out = models.project(t.embeddings, model, "embedding", "p")
    # the projection onto all components keeps the total variance
    return out.agg(*[F.var_samp(C("p")[i]).alias(f"v{i}") for i in range(64)]) \
        .select(F.round(sum((C(f"v{i}") for i in range(1, 64)), C("v0")), 6).alias("total"))


@query("m14_row_centred_pca", """
WITH x AS (SELECT vec_id, list_avg(embedding::DOUBLE[]) AS m, embedding::DOUBLE[] AS e FROM embeddings)
SELECT round(sum(list_sum(list_transform(e, lambda v: (v - m) * (v - m)))), 5) AS total FROM x""")
def _(t: Tables):
    model = models.train_row_centred_pca(t.embeddings, "embedding", 64)
    return model.select(F.round(F.aggregate("eigenvalues", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("m16_lda")
def _(t: Tables):
    model = models.train_lda(t.embeddings, "embedding", "label", 2)
    out = models.project(t.embeddings, model, "embedding", "p")
    return out.groupBy("label").agg(F.avg(C("p")[0]).alias("m0"), F.stddev(C("p")[0]).alias("s0"))


def _sequences(t: Tables):
    """Per user and day: kind of event as state, size class of the value as symbol."""
    symbol = F.when(C("value") < 20, 0).when(C("value") < 70, 1).otherwise(2)
    return t.events.select("user_id", F.to_date("ts").alias("day"), "ts", C("event_type").alias("state"), symbol.alias("symbol"))


@query("m17_hmm_frequencies", """
WITH s AS (SELECT event_type AS state, CAST(CASE WHEN value < 20 THEN 0 WHEN value < 70 THEN 1 ELSE 2 END AS VARCHAR) AS symbol,
                  lag(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts) AS prev FROM events),
n AS (SELECT 'i' AS kind, '' AS a, state AS b, count(*) AS n FROM s WHERE prev IS NULL GROUP BY ALL
      UNION ALL SELECT 't', prev, state, count(*) FROM s WHERE prev IS NOT NULL GROUP BY ALL
      UNION ALL SELECT 'e', state, symbol, count(*) FROM s GROUP BY ALL)
SELECT kind, a, b, round(n / sum(n) OVER (PARTITION BY kind, a), 8) AS p FROM n""")
def _(t: Tables):
    return hmm.frequencies(_sequences(t), ["user_id", "day"], "ts", "state", "symbol").withColumn("p", F.round("p", 8))


def _small_hmm(t: Tables):
    rows = hmm.frequencies(_sequences(t), ["user_id", "day"], "ts", "state", "symbol")
    states = [r[0] for r in t.events.select("event_type").distinct().orderBy("event_type").collect()]
    return hmm.to_model(rows, states, ["0", "1", "2"])


@query("m18_baum_welch")
def _(t: Tables):
    packed = hmm.blocks(_sequences(t), ["user_id"], "ts", "symbol", 5000)
    model = hmm.baum_welch(packed, ["user_id"], _small_hmm(t), 2)
    rows = [(i, [float(x) for x in model.transition[i]], [float(x) for x in model.emission[i]]) for i in range(len(model.initial))]
    return t.spark.createDataFrame(rows, "state int, transition array<double>, emission array<double>")


@query("m19_viterbi")
def _(t: Tables):
    packed = hmm.blocks(_sequences(t), ["user_id"], "ts", "symbol", 5000)
    return hmm.viterbi(packed, ["user_id"], _small_hmm(t)).select("user_id", "block", F.size("states").alias("n"))
