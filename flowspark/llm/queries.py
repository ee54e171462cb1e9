"""One registered query for each operator of this part, over its whole table, with SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowspark.llm import bpe, decontaminate, fingerprints, langid, licenses, minhash, mixing, periods, quality, spelling, substrings, tokens, warc
from flowspark.llm.shared import ready

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, table: str = "documents", sql: str | None = None):
    def wrap(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(ready(spark).read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def vocabulary(name: str) -> tuple[str, str]:
    """Place of a public vocabulary file and the pattern that belongs to the rank files."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


@query("op1_byte_bpe")
def byte_bpe(documents: DataFrame) -> DataFrame:
    return bpe.round_trip(documents, *vocabulary("byte_bpe_50k.tiktoken"))


@query("op3_minhash_near_dedup", sql=minhash.ORACLE)
def minhash_near_dedup(documents: DataFrame) -> DataFrame:
    return minhash.near_duplicates(documents)


@query("op4_document_fingerprints")
def document_fingerprints(documents: DataFrame) -> DataFrame:
    return fingerprints.compared(documents)


@query("op6_token_counts")
def token_counts(documents: DataFrame) -> DataFrame:
    return tokens.token_counts(documents, vocabulary("piece_bpe_32k.model")[0])


@query("op2_license_scan", sql=licenses.oracle())
def license_scan(documents: DataFrame) -> DataFrame:
    return licenses.labelled(documents)


@query("op8_substring_dedup", sql=substrings.ORACLE)
def substring_dedup(documents: DataFrame) -> DataFrame:
    return substrings.repeats(documents)


@query("op5_source_mixing", sql=mixing.ORACLE)
def source_mixing(documents: DataFrame) -> DataFrame:
    return mixing.plan(documents).drop("text_md5")


@query("op10_quality_outliers")
def quality_outliers(documents: DataFrame) -> DataFrame:
    return quality.judged(documents)


@query("op9_language_id")
def language_id(documents: DataFrame) -> DataFrame:
    return langid.predictions(documents)


@query("op7_warc_archives", table="pages", sql=warc.ORACLE)
def warc_archives(pages: DataFrame) -> DataFrame:
    return warc.archived(pages)


def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    read = ready(spark).read
    return decontaminate.judged(read.parquet(f"{folder}/documents.parquet"), read.parquet(f"{folder}/benchmark.parquet"))


QUERIES["op11_benchmark_decontamination"] = benchmark_decontamination
ORACLE["op11_benchmark_decontamination"] = decontaminate.ORACLE


@query("op12_periodic_runs", sql=periods.ORACLE)
def periodic_runs(documents: DataFrame) -> DataFrame:
    return periods.judged(documents)


@query("op13_spelling_variants", sql=spelling.ORACLE)
def spelling_variants(documents: DataFrame) -> DataFrame:
    return spelling.variants(documents)
