from pyspark.sql import functions as F

from flowspark.operators import aggregates as A
from flowspark.operators import enrich, joins, upsert
from flowspark.operators import rules as R
from flowspark.plans import branch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute_rank(values, p):
    import math

    s = sorted(values)
    if not s:
        return 0.0
    hi, lo = math.floor(len(s) * (p + 0.01)), math.ceil((len(s) - 1) * (p - 0.01))
    if hi == lo:
        return s[hi]
    if hi - lo == 1:
        return s[lo] if hi >= len(s) else (s[hi] + s[lo]) / 2
    part = s[lo + 1:hi]
    return sum(part) / len(part)


def test_percent_rank_mean(spark):
    data = [(k, float((i * 37) % 101)) for k, n in (("a", 200), ("b", 3), ("c", 41)) for i in range(n)] + [("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    for p in (0.5, 0.9, 0.1):
        got = dict(rows(A.percent_rank_mean(df, ["k"], "v", p)))
        for k in ("a", "c"):
            assert abs(got[k] - brute_rank([v for q, v in data if q == k], p)) < 1e-9
        assert got["none"] == 0.0


def test_percent_rank_fixture(spark):
    data = [("x", 11), ("x", 12), ("x", 13), ("y", 14), ("y", 15), ("y", 16), ("z", 20), ("z", 21), ("z", 22), ("w", 22)]
    df = spark.createDataFrame(data, "a string, b long")
    assert A.percent_rank_mean(df, ["a"], "b", 0.99).count() == 4


def test_range_matches_equal_brute_force(spark):
    ranges = [(0, 0), (5, 9), (8, 1000), (100, 100), (512, 70000), (7, 7)]
    pts = list(range(0, 1100, 7)) + [0, 5, 9, 100, 512, 70000]
    r = spark.createDataFrame([(a, b, f"{a}-{b}") for a, b in ranges], "lo long, hi long, name string")
    p = spark.createDataFrame([(x,) for x in set(pts)], "p long")
    want = sorted((x, f"{a}-{b}") for x in set(pts) for a, b in ranges if a <= x <= b)
    assert rows(enrich.range_matches(p, "p", r, "lo", "hi").select("p", "name")) == want


def test_ip_location(spark):
    table = spark.createDataFrame([(16909056, 16909311, "X"), (167772160, 167772415, "hidden")], "lo long, hi long, city string")
    own = spark.createDataFrame([("10.0.0.9", "home")], "ip string, city string")
    df = spark.createDataFrame([("1.2.3.4",), ("10.0.0.1",), ("10.0.0.9",), ("bad",), ("9.9.9.9",)], "ip string")
    got = dict(rows(enrich.ip_location(df, "ip", table, "lo", "hi", own)))
    assert got == {"1.2.3.4": "X", "10.0.0.1": None, "10.0.0.9": "home", "bad": None, "9.9.9.9": None}


def test_lookup_collision_and_first_row(spark):
    df = spark.createDataFrame([(1, "own"), (2, "own"), (None, "own")], "id int, name string")
    table = spark.createDataFrame([(1, "b"), (1, "a")], "key int, name string")
    assert rows(enrich.lookup(df.where("id IS NOT NULL"), table, "id", "key")) == [(1, "own", "a"), (2, "own", None)]
    assert enrich.lookup(df, table, "id", "key").count() == 3


def test_condition_lookup_with_range_anchor(spark):
    df = spark.createDataFrame([(1, 5), (2, 50)], "id int, v long")
    table = spark.createDataFrame([(0, 10, 3, "a"), (0, 10, 1, "b"), (40, 60, 9, "c")], "lo long, hi long, w int, n string")
    out = enrich.condition_lookup(df, table, "w < 5", ["w"], "id", between=("v", "lo", "hi"))
    assert rows(out.select("id", "n")) == [(1, "b"), (2, None)]


def test_condition_lookup_below_a_limit(spark):
    """Ties, repeated rows and ids, missing keys and values as by all pairs, though no record meets more than its best rows."""
    df = spark.range(400).selectExpr("if(id % 50 = 7, null, id % 390) AS id", "if(id % 13 = 0, null, int(id % 3)) AS k",
                                     "if(id % 17 = 0, null, double(id * 7919 % 101)) AS top")
    table = spark.range(300).selectExpr("if(id % 11 = 0, null, int(id % 4)) AS k", "if(id % 19 = 0, null, double(id * 31 % 53)) AS v",
                                        "if(id % 5 = 0, null, id % 7) AS w", "string(id % 23) AS n")
    table = table.union(table.limit(40)).withColumn("_down", -F.col("v"))
    given = [df, table, "v < top", ["_down", "w"], "id", ["k"]]
    out = enrich.condition_lookup(*given, below=("v", "top"))
    plain = enrich.condition_lookup(*given)
    assert out.exceptAll(plain).count() == 0 and plain.exceptAll(out).count() == 0 and out.where("n IS NOT NULL").count() > 200
    # one key, a billion pairs: none of them is laid out
    many = spark.range(40000).selectExpr("id", "1 AS k", "double(id) AS top")
    rows_of = spark.range(25000).selectExpr("1 AS k", "id * 2.0D AS v", "id AS w")
    far = enrich.condition_lookup(many, rows_of.withColumn("_down", -F.col("v")), "v < top", ["_down"], "id", ["k"], below=("v", "top"))
    assert far.where("w IS NULL OR w <> least(ceil(id / 2) - 1, 24999)").count() == 1  # nothing lies below zero


def test_text_key_join(spark):
    left = spark.createDataFrame([(1, "l1"), (None, "l2")], "k int, x string")
    right = spark.createDataFrame([("1", "r1"), (None, "r2"), ("1.0", "r3")], "k string, x string")
    assert rows(joins.text_key_join(left.withColumnRenamed("k", "a"), right, [("a", "k")]).select("a", "x").fillna(-1)) == [(-1, "r2"), (1, "r1")]


def test_fill_missing(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 4.0)], "a double, b double")
    assert rows(enrich.fill_missing(df, ["b"])) == [(1.0, 0.0), (3.0, 4.0)]
    assert rows(enrich.fill_missing(df, ["b"], "avg")) == [(1.0, 4.0), (3.0, 4.0)]


def test_merges(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, n string, c int")
    batch = spark.createDataFrame([(2, None, 5, 1), (2, "bb", 6, 2), (3, "c", 7, 1)], "k int, n string, c int, t int")
    assert rows(upsert.merge_partial(stored, batch, ["k"], ["t"]).select("k", "n", "c")) == [(1, "a", 1), (2, "bb", 6), (3, "c", 7)]
    partial = spark.createDataFrame([(1, None, 9, 1)], "k int, n string, c int, t int")
    assert rows(upsert.merge_partial(stored, partial, ["k"], ["t"]).select("k", "n", "c"))[0] == (1, "a", 9)
    added = spark.createDataFrame([(2, 10), (2, 1), (4, 3)], "k int, c int")
    assert rows(upsert.merge_add(stored, added, ["k"], ["c"]).select("k", "c")) == [(1, 1), (2, 13), (4, 3)]


def test_merge_children(spark):
    parents = spark.createDataFrame([(1, [(1, "a"), (2, "b")]), (2, None)], "p int, kids array<struct<id:int,v:string>>")
    kids = spark.createDataFrame([(1, 2, "B", 1), (1, 3, "c", 1), (1, 3, "cc", 2), (2, 1, "x", 1), (9, 1, "lost", 1)], "p int, id int, v string, t int")
    latest = upsert.last_per_key(kids, ["p", "id"], ["t"]).drop("t")
    out, orphans = upsert.merge_children(parents, latest, "p", "id", "kids", ["id"])
    got = {r["p"]: [(k["id"], k["v"]) for k in r["kids"]] for r in out.collect()}
    assert got == {1: [(1, "a"), (2, "B"), (3, "cc")], 2: [(1, "x")]}
    assert rows(orphans.select("v")) == [("lost",)]


def test_branches_overlap_and_default(spark):
    df = spark.createDataFrame([("ab",), ("a",), ("z",), (None,)], "k string")
    outs = branch.branches(df, "k", [("a", None), ("ab", None)], None, "prefix")
    assert [o.count() for o in outs] == [2, 1, 2]
    total = branch.branch_union(df, "k", [("a",), ("ab",)], "prefix").groupBy("branch").count()
    assert dict(rows(total)) == {0: 2, 1: 1, 2: 2}


def test_channel_tree_builds_shared_parts_once(spark):
    made = []

    def mark(df):
        made.append(1)
        return df

    shared = branch.Analyzed(branch.Source("t", [R.add_fields({"x": "%{id}"})]), mark)
    tree = branch.Joined(shared, branch.Analyzed(shared, lambda df: df.select("id", F.lit("r").alias("y"))), [("id", "id")])
    assert branch.build(tree, {"t": spark.range(3)}).count() == 3 and made == [1]


def test_label_pairs(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "l string")
    assert rows(joins.label_pairs(df, "l")) == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c")]


def test_choose_level_and_split(spark):
    df = spark.range(10).select(F.col("id"), F.timestamp_seconds("id").alias("ts"))
    import datetime as dt

    a, b = dt.datetime(1970, 1, 1), dt.datetime(1970, 1, 1, 0, 0, 9)
    assert [A.choose_level(df, "ts", a, b, lo, hi) for lo, hi in ((1, 5), (20, 30), (5, 30))] == ["hour", "second", "minute"]
    train, test = A.half_split(df, ["id"])
    assert train.count() == 6 and test.count() == 4 and train.agg(F.max("id")).first()[0] == 5
