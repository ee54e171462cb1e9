"""Batch joins with the record semantics of text keys, and first-match enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.plans.scale import first_per_key, lookup_join, salted_join


def _text_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.withColumns({f"_k{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(on)})


def text_key_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Inner join on keys compared as text, a missing key being `""`; the right side's columns win."""
    keys = [f"_k{i}" for i in range(len(on))]
    l = _text_keys(left, [a for a, _ in on])
    r = _text_keys(right, [b for _, b in on])
    shared = [c for c in left.columns if c in right.columns]
    l = l.drop(*shared)
    return salted_join(l, r, keys).select(*[c for c in left.columns if c not in shared], *right.columns)


def join_with(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], outputs: dict[str, str]) -> DataFrame:
    """Join as `text_key_join`, result columns by SQL over the records `l` and `r`."""
    keys = [f"_k{i}" for i in range(len(on))]
    l = _text_keys(left, [a for a, _ in on]).select(*keys, F.struct(*left.columns).alias("l"))
    r = _text_keys(right, [b for _, b in on]).select(*keys, F.struct(*right.columns).alias("r"))
    return salted_join(l, r, keys).select(*[F.expr(e).alias(n) for n, e in outputs.items()])


def first_match(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], order: Sequence[str]) -> DataFrame:
    """Every left record with the first matching right record."""
    keys = [a for a, _ in on]
    named = right
    for a, b in on:
        named = named.withColumnRenamed(b, a) if a != b else named
    one = first_per_key(named, keys, order)
    clash = [c for c in one.columns if c in left.columns and c not in keys]
    return lookup_join(left, one.drop(*clash), keys).select(*left.columns, *[c for c in one.columns if c not in left.columns])


def label_pairs(df: DataFrame, label: str, max_labels: int = 2000) -> DataFrame:
    """Unordered pairs of the distinct labels, a label with itself included.

    Pairs are part of the result here (one model each); the label set is checked to be small and
    packed into one row instead of a cross join.
    """
    labels = df.select(label).where(F.col(label).isNotNull()).distinct()
    if labels.limit(max_labels + 1).count() > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    every = labels.agg(F.array_sort(F.collect_list(label)).alias("all"))
    return (
        every.select(F.explode("all").alias("first"), "all")
        .select("first", F.explode(F.filter("all", lambda x: x >= F.col("first"))).alias("second"))
    )


def with_group_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each row with the means of its group (left join to the pre-aggregated means)."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])
    return lookup_join(df, means, list(keys))


def aligned(forecast: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Forecast rows next to the actual rows of the same time, field and group."""
    return forecast.join(actual, list(keys), "inner")
