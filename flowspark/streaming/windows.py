"""Event time, watermarks and window aggregates on streams, and running a stream to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.plans.scale import shared_folder


def event_time(df: DataFrame, field: str, out_of_order: str = "10 seconds") -> DataFrame:
    """Event time from a timestamp or epoch-millisecond field, with a bounded delay.

    A value that is no time gives null and does not move the watermark.
    """
    kind = df.schema[field].dataType
    if isinstance(kind, T.NumericType):
        moment = F.timestamp_millis(F.col(field).cast("long"))
    elif isinstance(kind, T.StringType):
        moment = F.coalesce(F.timestamp_millis(F.col(field).try_cast("long")), F.try_to_timestamp(field))
    else:
        moment = F.col(field).cast("timestamp")
    return df.withColumn(field, moment).withWatermark(field, out_of_order)


def arrival_time(df: DataFrame, name: str = "arrived", out_of_order: str = "0 seconds") -> DataFrame:
    """Ingestion or processing time as a column that windows can use: the time of the micro-batch, which the checkpoint
    keeps for a repeated batch. A time that the column holds already stays, as the end of a bounded stream has one."""
    known = F.col(name) if name in df.columns else F.lit(None).cast("timestamp")
    return df.withColumn(name, F.coalesce(known, F.current_timestamp())).withWatermark(name, out_of_order)


def tumbling(ts: str, width: str) -> Column:
    return F.window(ts, width)


def sliding(ts: str, size: str, slide: str) -> Column:
    return F.window(ts, size, slide)


def session(ts: str, gap: str) -> Column:
    return F.session_window(ts, gap)


def window_aggregate(df: DataFrame, window: Column, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """One row per window and key; write it in append mode to get each window once."""
    out = df.groupBy(window.alias("_w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("_w.start").alias("w_start"), F.col("_w.end").alias("w_end"), *keys, *aggs)


def window_series(df: DataFrame, ts: str, keys: Sequence[str], value: str, grain: str, size: str, slide: str) -> DataFrame:
    """Per key and sliding window the slot means in time order.

    Values are averaged per slot first, so the list of a window is as long as size / grain however
    busy the key is. Both aggregates run in one append-mode query.
    """
    slots = df.groupBy(*keys, F.window(ts, grain).alias("_s")).agg(F.avg(value).alias("_v"))
    slots = slots.withColumn("_at", F.window_time("_s"))
    packed = slots.groupBy(*keys, F.window("_at", size, slide).alias("_w")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_s.start").alias("t"), F.col("_v").alias("v")))).alias("points"))
    return packed.select(*keys, F.col("_w.start").alias("w_start"), F.col("_w.end").alias("w_end"), "points")


# -- running ------------------------------------------------------------------------------

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None,
                 folder: str | None = None) -> str:
    """Process all data there is, then stop; the folder of the result table is returned.

    Every micro-batch owns the sub-folder `batch=<id>`, so a repeated batch replaces its own output. Stateful processors
    get the RocksDB store they need.
    """
    folder = folder or f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    spark = df.sparkSession
    before = spark.conf.get(STORE)
    if "TransformWithState" in df._jdf.queryExecution().logical().toString():
        spark.conf.set(STORE, ROCKSDB)
    try:  # a query keeps the settings it was started with
        handle = (df.writeStream.outputMode(mode).foreachBatch(each or write)
                  .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    finally:
        spark.conf.set(STORE, before)
    handle.awaitTermination()
    return f"{folder}/out"


def read_result(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a finished stream (none when no batch wrote anything)."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    try:
        return spark.read.schema(schema).parquet(folder).select(*schema.names)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def finished(df: DataFrame, mode: str = "append") -> DataFrame:
    """A stream run over all data there is, as a static table."""
    return read_result(df.sparkSession, run_to_table(df, mode), df.schema)


class Closing:
    """The end of a bounded stream: a final watermark that closes every window still open.

    `attach` adds an empty second source to the stream. After all data is processed, marker rows far past any event time
    are written there and the query runs on from its checkpoint: the watermark passes the end of every window of the
    data, which comes out once, like those before. The markers' own windows stay open, so they are never part of a
    result. A query that filters or joins drops markers that don't pass: `markers` names the values they need.
    """

    END = "9999-12-30 00:00:00"

    def __init__(self, spark: SparkSession, ts: str, *markers: dict):
        self.spark, self.ts, self.markers = spark, ts, markers or ({},)
        self.folder = f"{shared_folder(spark)}/end-{uuid.uuid4().hex}"
        self.schema: T.StructType | None = None

    def attach(self, df: DataFrame) -> DataFrame:
        """`df`, before it gets its event time, with the source of the markers."""
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        self.spark.createDataFrame([], self.schema).write.parquet(self.folder)
        return df.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def _mark(self) -> None:
        number = isinstance(self.schema[self.ts].dataType, T.NumericType)
        last = F.unix_millis(F.lit(self.END).cast("timestamp")) if number else F.lit(self.END)
        rows = self.spark.range(1).select(F.explode(F.array(*[F.struct(*[
            (last if f.name == self.ts else F.lit(marker.get(f.name))).cast(f.dataType).alias(f.name) for f in self.schema.fields])
            for marker in self.markers])).alias("r")).select("r.*")
        rows.write.mode("append").parquet(self.folder)

    def run_to_table(self, df: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None,
                     folder: str | None = None, beside: Sequence[Closing] = ()) -> str:
        """Run the stream to its end and beyond; `beside` are the ends of its other sources."""
        folder = folder or f"{shared_folder(self.spark)}/stream-{uuid.uuid4().hex}"
        run_to_table(df, mode, each, folder)
        for end in (self, *beside):
            end._mark()
        return run_to_table(df, mode, each, folder)

    def finished(self, df: DataFrame, mode: str = "append", beside: Sequence[Closing] = ()) -> DataFrame:
        return read_result(self.spark, self.run_to_table(df, mode, beside=beside), df.schema)
