"""Plan shapes that keep work even when one key holds a large share of the rows.

* `ordered` numbers rows inside a key without ever putting a key into one task;
  `around`, `lags` and `carry` build window results on top of that numbering.
* `first_per_key` / `last_per_key` replace `row_number() = 1` by a partial aggregate.
* `lookup_join` broadcasts only a side it has measured, else salts the heavy keys.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
HEAVY_ROWS = 1_000_000
SMALL_SCAN = 32


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; one of our own only in local mode without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="flowspark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class WorkTables:
    """Parquet tables of one job in the shared folder. A newer version of a table replaces the older one, so a loop
    holds one version of each; nothing read later may depend on a replaced one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.versions: dict[str, int] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """`df` written and read back: a cut in the lineage that survives a lost executor."""
        old, new = self.versions.get(name), self.versions.get(name, 0) + 1
        df.write.parquet(f"{self.folder}/{name}/{new}")
        self.versions[name] = new
        if old is not None:
            self._delete(f"{name}/{old}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}/{new}")

    def drop(self, *names: str) -> None:
        for name in names:
            if self.versions.pop(name, None) is not None:
                self._delete(name)

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{place}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A scan of a few row groups, laid out over the cores before heavy row work.

    Only what is smaller than `SMALL_SCAN` splits is shuffled: beyond that a scan is wide enough as it is, however many
    cores there are. Splits without a row group's start have no rows and don't count.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, SMALL_SCAN)
    few = df.rdd.getNumPartitions() < wanted or df.select(F.spark_partition_id()).distinct().count() < wanted
    return df.repartition(wanted) if few else df


def _text_size(df: DataFrame) -> Column:
    """Bytes one row takes, from its real values."""
    size = F.lit(16)
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = F.coalesce(F.octet_length(col), F.lit(0))
        elif isinstance(field.dataType, T.AtomicType):
            width = F.lit(16)
        else:
            width = F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0))
        size = size + width
    return size


def measured_bytes(df: DataFrame) -> int:
    """Size of a table from one aggregate over its real values."""
    row = df.agg(F.sum(_text_size(df)).alias("bytes")).first()
    return int(row["bytes"] or 0)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """`df` with a broadcast hint when its measured size allows one."""
    small = measured_bytes(df) <= max_bytes
    return (F.broadcast(df) if small else df), small


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key; combined before the shuffle, so a hot key costs one row per task."""
    return _edge_per_key(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _edge_per_key(df, keys, order, F.max_by)


def _edge_per_key(df, keys, order, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # the row hash settles ties, so the same row wins on every run
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order],
                     F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    picked = df.groupBy(*keys).agg(pick(F.struct(*[F.col(f"`{c}`") for c in rest]), place).alias("_row"))
    return picked.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest]).select(*df.columns)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys."""
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(right[key])
    return cond


def join_back(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe join that keeps the left keys once; `right` must have one row per key."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(renamed[f"_r_{key}"])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


# ---------------------------------------------------------------------------
# joins with heavy keys

def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                heavy_rows: int = HEAVY_ROWS, rows: int | None = None) -> DataFrame:
    """Equi join where keys with many left rows are spread over several tasks.

    Without `rows` nothing is counted beforehand: adaptive execution splits the large partitions of such a join from the
    sizes its shuffle reports, so the left side is computed once. With `rows`, the known size of a written `left`, heavy
    keys are found by an exact partial count; their left rows get a salt, their right rows one copy per salt. The salt is
    a hash of the row, so a retried task deals its rows out as before. Rows with a missing key match nothing and are dealt
    out by their hash. `how`: inner, left, left_semi, left_anti.
    """
    if rows is None or rows <= heavy_rows:
        return left.join(right, list(keys), how)
    # at most rows / heavy_rows keys are heavy, so this table is small whatever `left` is
    heavy = checkpoint(left.groupBy(*keys).count().where(F.col("count") > heavy_rows).select(
        *keys, F.ceil(F.col("count") / heavy_rows).cast("int").alias("_salts")))
    dealt = F.xxhash64(*[F.col(f"`{f.name}`") for f in left.schema.fields if "map<" not in f.dataType.simpleString()])
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    spread_over = F.when(missing, F.lit(max(1, rows // heavy_rows))).otherwise(F.coalesce(F.col("_salts"), F.lit(1)))
    salted_left = left.join(F.broadcast(heavy), list(keys), "left").withColumn(
        "_salt", F.pmod(dealt, spread_over.cast("long")).cast("int")).drop("_salts")
    salted_right = (
        right.join(F.broadcast(heavy), list(keys), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def lookup_join(left: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left",
                max_bytes: int = BROADCAST_BYTES, heavy_rows: int = HEAVY_ROWS, bound: DataFrame | None = None) -> DataFrame:
    """Join to a reference table: broadcast when measured small, salted shuffle join beyond.

    `bound` is a table `dim` cannot be larger than (its input before duplicates went); when that
    is small already, `dim` need not be computed to be measured.
    """
    if bound is not None and measured_bytes(bound) <= max_bytes:
        return left.join(F.broadcast(dim), list(keys), how)
    hinted, small = broadcast_if_small(dim, max_bytes)
    if small:
        return left.join(hinted, list(keys), how)
    return salted_join(left, dim, keys, how, heavy_rows)


# ---------------------------------------------------------------------------
# order inside keys without one task per key

def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Add `_pos` (1-based place in its key), `_n` (rows of the key) and `_seg` (range slice).

    Rows are range-partitioned by key *and* order, so a hot key is cut into as many slices as
    its share of the data asks for. Places are counted per slice and shifted by the rows of the
    earlier slices of the same key, a table of at most one row per key and slice. The laid-out
    rows are written to the checkpoint folder: range bounds come from a sample and must not be
    drawn twice.
    """
    keys, order = list(keys), list(order)
    # without a number, small tables are coalesced at run time
    ranged = df.repartitionByRange(parts, *keys, *order) if parts else df.repartitionByRange(*keys, *order)
    laid = checkpoint(
        ranged.sortWithinPartitions(*keys, *order)
        .withColumn("_seg", F.spark_partition_id()).withColumn("_seg_row", F.monotonically_increasing_id())
    )
    slices = laid.groupBy(*keys, "_seg").agg(F.min("_seg_row").alias("_seg_first"), F.count(F.lit(1)).alias("_seg_rows"))
    by_key = Window.partitionBy(*keys)
    slices = slices.select(
        *keys, "_seg", "_seg_first",
        (F.sum("_seg_rows").over(by_key.orderBy("_seg")) - F.col("_seg_rows")).alias("_seg_before"),
        F.sum("_seg_rows").over(by_key).alias("_n"),
    )
    return (
        join_back(laid, slices, [*keys, "_seg"])
        .withColumn("_pos", F.col("_seg_row") - F.col("_seg_first") + F.col("_seg_before") + 1)
        .drop("_seg_row", "_seg_first", "_seg_before")
    )


def around(df: DataFrame, keys: Sequence[str], before: int, after: int,
           exprs: Callable[[object], dict[str, Column]], block: int = 50_000) -> DataFrame:
    """Window results that look at most `before` rows back and `after` rows on.

    `df` comes from `ordered`. Positions are cut into blocks and each block also gets copies of
    the few rows it has to see from its neighbours, so a window never spans more than one block.
    `exprs(window)` gives the new columns over a window ordered by `_pos`.
    """
    block = max(block, before, after, 1)
    here = F.floor((F.col("_pos") - 1) / block)
    offset = F.pmod(F.col("_pos") - 1, F.lit(block))
    homes = F.filter(
        F.array(here,
                F.when(offset >= block - before, here + 1) if before else F.lit(None).cast("long"),
                F.when(offset < after, here - 1) if after else F.lit(None).cast("long")),
        lambda b: b.isNotNull())
    spread = df.withColumn("_home", here).withColumn("_block", F.explode(homes))
    window = Window.partitionBy(*keys, "_block").orderBy("_pos")
    return (
        spread.withColumns(exprs(window))
        .where(F.col("_home") == F.col("_block")).drop("_home", "_block")
    )


def lags(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """`wanted`: new name -> (column, k); k > 0 looks back, k < 0 ahead. `df` comes from `ordered`."""
    back = max([k for _, k in wanted.values()] + [0])
    ahead = max([-k for _, k in wanted.values()] + [0])
    return around(df, keys, back, ahead, lambda w: {
        name: (F.lag(col, k) if k >= 0 else F.lead(col, -k)).over(w) for name, (col, k) in wanted.items()})


def carry(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Results that depend on all earlier (or later) rows of a key, in two levels.

    `wanted`: new name -> (column, kind) with kind `previous` (last non-null up to here), `next`
    (first non-null from here) or `sum` (running sum). Each slice is solved alone; one summary row
    per key and slice carries the state across slices.
    """
    keys = list(keys)
    inside = Window.partitionBy(*keys, "_seg").orderBy("_pos")
    over = Window.partitionBy(*keys).orderBy("_seg")
    unbounded, current = Window.unboundedPreceding, Window.currentRow
    upto = inside.rowsBetween(unbounded, current)
    # "from here on" is a running frame over the reverse order: frames open to the end are quadratic
    onward = Window.partitionBy(*keys, "_seg").orderBy(F.desc("_pos")).rowsBetween(unbounded, current)
    over_back = Window.partitionBy(*keys).orderBy(F.desc("_seg")).rowsBetween(unbounded, -1)
    local, total, brought, final = {}, [], {}, {}
    for name, (col, kind) in wanted.items():
        if kind == "previous":
            local[f"_l_{name}"] = F.last(col, True).over(upto)
            total.append(F.max_by(col, F.when(F.col(col).isNotNull(), F.col("_pos"))).alias(f"_t_{name}"))
            brought[f"_b_{name}"] = F.last(f"_t_{name}", True).over(over.rowsBetween(unbounded, -1))
            final[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_b_{name}"))
        elif kind == "next":
            local[f"_l_{name}"] = F.last(col, True).over(onward)
            total.append(F.min_by(col, F.when(F.col(col).isNotNull(), F.col("_pos"))).alias(f"_t_{name}"))
            brought[f"_b_{name}"] = F.last(f"_t_{name}", True).over(over_back)
            final[name] = F.coalesce(F.col(f"_l_{name}"), F.col(f"_b_{name}"))
        elif kind == "sum":
            local[f"_l_{name}"] = F.sum(col).over(upto)
            total.append(F.sum(col).alias(f"_t_{name}"))
            brought[f"_b_{name}"] = F.sum(f"_t_{name}").over(over.rowsBetween(unbounded, -1))
            final[name] = F.coalesce(F.col(f"_l_{name}"), F.lit(0)) + F.coalesce(F.col(f"_b_{name}"), F.lit(0))
        else:
            raise ValueError(f"unknown kind {kind}")
    summary = df.groupBy(*keys, "_seg").agg(*total).withColumns(brought).select(*keys, "_seg", *brought)
    return (
        join_back(df.withColumns(local), summary, [*keys, "_seg"]).withColumns(final)
        .drop(*local, *brought)
    )


def settle(df: DataFrame) -> DataFrame:
    """Drop the helper columns of `ordered`."""
    return df.drop("_seg", "_pos", "_n")
