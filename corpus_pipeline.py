"""A training corpus from raw documents: each stage is one operator over all that the stage before kept."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from flowspark.llm import bpe, langid, minhash, mixing, substrings
from flowspark.llm.queries import vocabulary
from flowspark.llm.shared import ready, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised go."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur again are cut out of the texts; `n_chars` follows."""
    return substrings.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask for, within the corpus's own number of tokens."""
    return mixing.mixed(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    return bpe.reencoded(docs, *vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("language id", language), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages),
          ("source mix", source_mix), ("byte-level bpe", tokenised)]

#: Trained models and tokenizers have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again as the next one's input."""
    docs = ready(spark).read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
