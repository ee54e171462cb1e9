"""Helpers of the training-data operators: shared work tables, Arrow batches of bounded size, word rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.plans.scale import shared_folder
from flowspark.session import prepare

#: Words are what stands between these characters: the blank and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ARROW_BYTES = 4 * 1024 * 1024
ARROW_ROWS = 2000


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: Arrow batches bounded by bytes, so long texts don't pile up in a worker."""
    prepare(spark)
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES)),
                       ("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: the cut in the lineage that survives a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(text: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(text: str | Column = "text") -> Column:
    """64 bits of a text, to tell rows of one id apart."""
    return F.xxhash64(whole(text))


def words(text: Column) -> Column:
    """Words between blanks, as an array without empty strings."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that `df` doesn't have (names clash without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def in_parts(rows: Iterable, size: Iterable[int], most: int) -> Iterator[list]:
    """Lists of rows whose sizes add up to at most `most`, or one row that is larger."""
    part, total = [], 0
    for row, n in zip(rows, size):
        if part and total + n > most:
            yield part
            part, total = [], 0
        part.append(row)
        total += n
    if part:
        yield part
