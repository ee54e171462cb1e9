from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowspark.plans import scale


def skewed(spark, n=3000):
    """One key holds two thirds of the rows; gaps in v; a null key."""
    key = F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 9 == 0, F.lit(None)).otherwise((F.col("id") % 5).cast("string"))
    return spark.range(n).select(key.alias("k"), ((F.col("id") * 7919) % n).alias("o"),
                                 F.when(F.col("id") % 4 == 0, F.col("id")).alias("v"))


def same(a, b):
    cols = a.columns
    return a.exceptAll(b.select(cols)).count() == 0 and b.select(cols).exceptAll(a).count() == 0


def test_ordered_lags_and_carry_equal_plain_windows(spark):
    df = skewed(spark)
    placed = scale.ordered(df, ["k"], ["o"], parts=7)
    assert placed.where("k = 'hot'").select("_seg").distinct().count() > 1  # the hot key is cut
    out = scale.lags(placed, ["k"], {"l1": ("o", 1), "l3": ("o", 3), "f2": ("o", -2)})
    out = scale.carry(out, ["k"], {"p": ("v", "previous"), "n": ("v", "next"), "s": ("v", "sum")})
    w = W.partitionBy("k").orderBy("o")
    want = df.select(
        "k", "o", "v", F.row_number().over(w).alias("_pos"), F.count("*").over(W.partitionBy("k")).alias("_n"),
        F.lag("o", 1).over(w).alias("l1"), F.lag("o", 3).over(w).alias("l3"), F.lead("o", 2).over(w).alias("f2"),
        F.last("v", True).over(w).alias("p"), F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("n"),
        F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"))
    assert same(out.drop("_seg"), want)


def test_around_sees_over_block_borders(spark):
    df = skewed(spark, 500)
    placed = scale.ordered(df, ["k"], ["o"])
    out = scale.around(placed, ["k"], 4, 0, lambda w: {"s": F.sum("o").over(w.rowsBetween(-4, 0))}, block=5)
    want = df.select("k", "o", F.sum("o").over(W.partitionBy("k").orderBy("o").rowsBetween(-4, 0)).alias("s"))
    assert same(out.select("k", "o", "s"), want)


def test_edges_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert {tuple(r) for r in scale.first_per_key(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", 5, "z")}
    assert {tuple(r) for r in scale.last_per_key(df, ["k"], ["o"]).collect()} == {("a", 2, "x"), ("b", 5, "z")}


def test_salted_join_keeps_all_rows(spark):
    """Most rows on one key, a third without a key: same rows with and without salts, and repeated rows stay."""
    left = skewed(spark).unionByName(skewed(spark).limit(50))
    right = left.select("k").distinct().withColumn("name", F.upper("k")).where("k <> '3' OR k IS NULL")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, ["k"], how)
        assert same(scale.salted_join(left, right, ["k"], how, heavy_rows=100, rows=left.count()), plain)
        assert same(scale.salted_join(left, right, ["k"], how, heavy_rows=100), plain)


def test_unmeasured_join_reads_its_input_once(spark, small):
    left = spark.read.parquet(f"{small}/events.parquet").select("user_id", "value")
    right = left.groupBy("user_id").count()
    plan = scale.salted_join(left, right, ["user_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_lookup_join_broadcasts_only_small_tables(spark):
    left = skewed(spark).where("k IS NOT NULL")
    dim = left.select("k").distinct().withColumn("name", F.lit("n"))
    small = scale.lookup_join(left, dim, ["k"])
    large = scale.lookup_join(left, dim, ["k"], max_bytes=1, heavy_rows=100)
    assert same(small, large)
    assert not scale.broadcast_if_small(dim, 1)[1] and scale.broadcast_if_small(dim)[1]
    assert scale.measured_bytes(dim) > 0


def test_checkpoint_uses_one_folder(spark):
    folder = scale.shared_folder(spark)
    assert scale.shared_folder(spark) == folder
    assert scale.checkpoint(spark.range(3)).count() == 3


def test_a_wide_scan_of_one_row_group_is_dealt_out(spark, tmp_path):
    """Many splits, all rows in one of them."""
    spark.range(60000).selectExpr("id", "sha2(string(id), 512) AS t").coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        scan = spark.read.parquet(str(tmp_path / "t"))
        assert scan.rdd.getNumPartitions() > 32
        assert scale.spread(scan).select(F.spark_partition_id()).distinct().count() == 8 and scale.spread(scan).count() == 60000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
