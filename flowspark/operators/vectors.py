"""Features: term frequencies, one-hot codes, scalar columns, vector joins."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, OneHotEncoder, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.casts import to_real
from flowspark.functions.text import as_col, squash
from flowspark.plans.scale import BROADCAST_BYTES, broadcast_if_small, checkpoint, join_back, salted_join

FEATURES = 1 << 20


def hashing_tf(df: DataFrame, tokens: str, out: str = "tf", binary: bool = False, features: int = FEATURES) -> DataFrame:
    return HashingTF(inputCol=tokens, outputCol=out, numFeatures=features, binary=binary).transform(df)


def sparse_sum(vector: str) -> Column:
    """Sum of a vector's stored values; the slots without one are never laid out."""
    return F.aggregate(F.unwrap_udt(vector)["values"], F.lit(0.0), lambda total, x: total + x)


def idf_table(df: DataFrame, row_id: str, tokens: str, min_doc_freq: int = 0) -> DataFrame:
    """`(token, df, idf)` with idf = ln((m + 1) / (df + 1)); 0 below the least document frequency."""
    total = df.count()
    pairs = df.select(row_id, F.explode(F.array_distinct(tokens)).alias("token"))
    freq = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return freq.withColumn("idf", _idf(total, min_doc_freq))


def _idf(total: int, min_doc_freq: int) -> Column:
    return F.when(F.col("df") >= min_doc_freq, F.log((F.lit(float(total)) + 1) / (F.col("df") + 1))).otherwise(0.0)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`(row id, token, tf)` of each row by itself, from `(row id, tokens)`."""
    for batch in batches:
        ids, tokens = batch.column(0), batch.column(1)
        words, rows = tokens.flatten(), pc.list_parent_indices(tokens)
        if words.null_count:
            words, rows = words.filter(words.is_valid()), rows.filter(words.is_valid())
        words, rows = words.dictionary_encode(), rows.to_numpy().astype(np.int64)
        size = max(len(words.dictionary), 1)
        pairs, counts = np.unique(rows * size + words.indices.to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(pairs // size)), words.dictionary.take(pa.array(pairs % size)),
                                          pa.array(counts.astype(np.int64))], names=[batch.schema.names[0], "token", "tf"])


def _term_counts(df: DataFrame, row_id: str, tokens: str) -> DataFrame:
    """`(row_id, token, tf)`, missing tokens left out.

    Terms are counted where their row lies, without a shuffle; only those of ids that several rows have are added up.
    """
    schema = T.StructType([df.schema[row_id], T.StructField("token", T.StringType()), T.StructField("tf", T.LongType())])
    ready = df.select(row_id, F.col(tokens).alias("_tokens"))

    def counted(part: DataFrame) -> DataFrame:
        return part.select(row_id, "_tokens").mapInArrow(_count_terms, schema)

    several = checkpoint(df.groupBy(row_id).agg(F.count(F.lit(1)).alias("_many")).where("_many > 1"))
    if several.isEmpty():
        return counted(ready)
    marked = join_back(ready, broadcast_if_small(several)[0], [row_id], "left")
    added = counted(marked.where("_many IS NOT NULL")).groupBy(row_id, "token").agg(F.sum("tf").alias("tf"))
    return counted(marked.where("_many IS NULL")).unionByName(added)


def tf_idf_rows(df: DataFrame, row_id: str, tokens: str, min_doc_freq: int = 0, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`(row_id, token, tf, tf_idf)`; of the token table the most frequent ones, up to a measured size, are broadcast.

    A token of one document alone needs no entry in that table. Terms cross a shuffle only for the tokens between, those of
    two documents or more that are too rare to be broadcast.
    """
    total = df.select(row_id).distinct().count()
    tf = _term_counts(df, row_id, tokens)
    freq = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    weights = checkpoint(freq.select("token", _idf(total, min_doc_freq).alias("idf"), F.floor(F.log2("df")).alias("_level")))
    alone = F.lit(math.log((total + 1.0) / 2) if min_doc_freq <= 1 else 0.0)
    lowest, room = 0, max_bytes
    size = F.sum(F.octet_length("token") + 32).alias("bytes")
    for level in weights.groupBy("_level").agg(size).orderBy(F.desc("_level")).collect():  # one row per power of two
        room -= level["bytes"]
        if room < 0:
            lowest = level["_level"] + 1
            break
    often = F.broadcast(weights.where(F.col("_level") >= lowest).drop("_level"))
    if lowest:
        rare = weights.where(F.col("_level") < lowest).drop("_level")
        found = tf.join(often, "token").unionByName(salted_join(tf.join(often, "token", "left_anti"), rare, ["token"], "left"))
    else:
        found = tf.join(often, "token", "left")
    return found.select(row_id, "token", "tf", (F.col("tf") * F.coalesce("idf", alone)).alias("tf_idf"))


def tf_idf(df: DataFrame, tokens: str, out: str = "vector", min_doc_freq: int = 0, features: int = FEATURES) -> DataFrame:
    """Sparse TF-IDF vector, appended to an existing vector of that name."""
    stages = Pipeline(stages=[
        HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_idf", minDocFreq=min_doc_freq)])
    made = stages.fit(df).transform(df).drop("_tf")
    return append_vector(made, out, "_idf")


def append_vector(df: DataFrame, vector: str, extra: str) -> DataFrame:
    """Join `extra` to the end of `vector`; make it when it is not there yet."""
    if vector not in df.columns:
        return df.withColumnRenamed(extra, vector)
    from pyspark.ml.feature import VectorAssembler

    joined = VectorAssembler(inputCols=[vector, extra], outputCol="_joined", handleInvalid="error").transform(df)
    return joined.drop(vector, extra).withColumnRenamed("_joined", vector)


def one_hot(df: DataFrame, column: str, out: str = "vector") -> DataFrame:
    """One slot per distinct value."""
    text = df.withColumn("_text", F.coalesce(F.col(column).cast("string"), F.lit("")))
    stages = Pipeline(stages=[
        StringIndexer(inputCol="_text", outputCol="_index", stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCol="_index", outputCol="_hot", dropLast=False)])
    made = stages.fit(text).transform(text).drop("_text", "_index")
    return append_vector(made, out, "_hot")


def date_slots(ts: str | Column) -> Column:
    """108 slots: month 12, week of month 5, weekday 7, hour 24, minute 60; one 1 in each block."""
    col = as_col(ts)
    week = F.least(F.floor((F.dayofmonth(col) - 1) / 7), F.lit(4))
    hits = [F.month(col) - 1, 12 + week, 17 + F.weekday(col), 24 + F.hour(col), 48 + F.minute(col)]
    hot = F.array(*[h.cast("int") for h in hits])
    return F.transform(F.sequence(F.lit(0), F.lit(107)), lambda i: F.when(F.array_contains(hot, i), 1.0).otherwise(0.0))


def scalar_array(df: DataFrame, columns: Sequence[str], scale: bool = True) -> Column:
    """Columns as one array: numbers and numeric text squashed, arrays element-wise, vectors as they
    are, anything else 0."""
    size = squash if scale else as_col
    parts = []
    for name in columns:
        kind = df.schema[name].dataType
        if isinstance(kind, VectorUDT):
            parts.append(vector_to_array(name))
        elif isinstance(kind, T.ArrayType):
            parts.append(F.transform(name, lambda x: F.coalesce(size(x.cast("double")), F.lit(0.0))))
        elif isinstance(kind, T.NumericType):
            parts.append(F.array(F.coalesce(size(F.col(name).cast("double")), F.lit(0.0))))
        elif isinstance(kind, T.StringType):
            parts.append(F.array(F.coalesce(size(to_real(name)), F.lit(0.0))))
        else:
            parts.append(F.array(F.lit(0.0)))
    return F.concat(*parts)


def scalar_vector(df: DataFrame, columns: Sequence[str], out: str = "vector", scale: bool = True) -> DataFrame:
    made = df.withColumn("_new", array_to_vector(scalar_array(df, columns, scale)))
    return append_vector(made, out, "_new")
