"""Record framing over text files: lines, delimiters, multi-line records, JSON and XML streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.rules import predicate
from flowspark.plans.scale import carry, ordered


def numbered(df: DataFrame, text: str = "value") -> DataFrame:
    """Text rows with their file and place in it: start of the file block, then row order inside it."""
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"), F.col("value").alias(text))


def decoded(df: DataFrame, text: str, encoding: str) -> DataFrame:
    """The text source keeps the bytes of a line as they are; read them in their encoding."""
    name = encoding.upper()
    if name in ("UTF-8", "UTF8"):
        return df
    raw = F.col(text).cast("binary")
    if name in ("US-ASCII", "ISO-8859-1", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32"):
        return df.withColumn(text, F.decode(raw, name))

    @F.pandas_udf("string")
    def decode(lines_of_bytes):
        return lines_of_bytes.map(lambda b: b.decode(encoding, "replace"))

    return df.withColumn(text, decode(raw))


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8", skip: int = 0) -> DataFrame:
    """Lines of text files; the first `skip` lines of every file are left out."""
    reader = spark.read.option("encoding", encoding)
    if encoding.upper().startswith(("UTF-16", "UTF-32")):  # a line end is more than one byte
        reader = reader.option("lineSep", "\n")
    df = decoded(numbered(reader.text(path)), "value", encoding)
    if not skip:
        return df
    first = df.where("block = 0").groupBy("path").agg(F.min("row").alias("_first"))
    kept = df.join(first, "path", "left")
    head = (F.col("block") == 0) & (F.col("row") - F.col("_first") < skip)
    return kept.where(~F.coalesce(head, F.lit(False))).drop("_first")


def delimited_records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """Records ended by a delimiter; `\\n`, `\\t` and `\\s` may be spelled out."""
    sign = delimiter.replace("\\n", "\n").replace("\\t", "\t").replace("\\s", " ")
    return numbered(spark.read.option("lineSep", sign).text(path))


def assemble(df: DataFrame, keys: list[str], order: list[str], text: str, pattern: str,
             at_start: bool = True) -> DataFrame:
    """Join lines to records. A record starts (or ends) at lines where the pattern is found.

    The record number is a running count of such lines, taken over range slices, so a long file
    is not read by one task.
    """
    hit = F.coalesce(F.col(text).rlike(pattern), F.lit(False)).cast("long")
    placed = ordered(df.withColumn("_hit", hit), keys, order)
    counted = carry(placed, keys, {"_rec": ("_hit", "sum")})
    record = F.col("_rec") if at_start else F.col("_rec") - F.col("_hit")
    return (
        counted.withColumn("_rec", record).groupBy(*keys, "_rec")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", F.col(text).alias("line")))).alias("_lines"))
        .select(*keys, F.col("_rec").alias("record"), F.size("_lines").alias("n_lines"),
                F.array_join(F.transform("_lines", lambda x: x.getField("line")), "").alias(text))
    )


def keep_matching(df: DataFrame, text: str, pattern: str) -> DataFrame:
    return df.where(F.col(text).rlike(pattern))


def record_filter(kind: str, col: str, value: str) -> Column:
    """prefix, suffix, match (whole record) or contain."""
    return predicate(kind, F.col(col), value)


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects written one after the other, over any number of lines.

    The text is read in pieces that end at a closing brace, so large files stay splittable. A
    running count of quotes tells which pieces begin inside a string, a running sum of braces
    outside strings tells where an object ends.
    """
    pieces = numbered(spark.read.option("lineSep", "}").text(path))
    plain = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    placed = ordered(pieces.withColumn("_quotes", quotes.cast("long")), ["path"], ["block", "row"])
    placed = carry(placed, ["path"], {"_upto": ("_quotes", "sum")})
    opened = (F.col("_upto") - F.col("_quotes")) % 2 == 1
    # text outside strings: a piece that begins inside one gets the missing opening quote
    outer = F.regexp_replace(F.concat(F.when(opened, F.lit('"')).otherwise(F.lit("")), plain), '"[^"]*("|$)', "")
    inside_end = F.col("_upto") % 2 == 1
    delta = F.length(outer) - F.length(F.replace(outer, F.lit("{"), F.lit(""))) - F.when(inside_end, 0).otherwise(1)
    last = F.col("_pos") == F.col("_n")
    counted = placed.withColumn("_delta", delta.cast("long")).withColumn("_closing", ~last)
    counted = carry(counted, ["path"], {"_depth": ("_delta", "sum")})
    counted = counted.withColumn("_end", F.when((F.col("_depth") == 0) & F.col("_closing") & ~inside_end, 1).otherwise(0).cast("long"))
    counted = carry(counted, ["path"], {"_ends": ("_end", "sum")})
    text = F.concat("value", F.when(F.col("_closing"), F.lit("}")).otherwise(F.lit("")))
    return (
        counted.withColumn("record", F.col("_ends") - F.col("_end"))
        .groupBy("path", "record")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", text.alias("t")))).alias("p"), F.max("_end").alias("whole"))
        .where("whole = 1")
        .select("path", "record", F.trim(F.regexp_replace(
            F.array_join(F.transform("p", lambda x: x.getField("t")), ""), r"^[^{]*", "")).alias("value"))
    )


def xml_records(spark: SparkSession, path: str, tag: str, schema=None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).load(path)
