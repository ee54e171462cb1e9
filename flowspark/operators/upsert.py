"""Keyed merges of a batch into a stored table; the result is a new snapshot to write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.plans.scale import last_per_key


def merge_partial(stored: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Insert, or update only the columns that have a value; the latest row of a key counts.

    Both sides have one row per key, so the full join has no hot key.
    """
    columns = [c for c in stored.columns if c not in keys]
    columns += [c for c in batch.columns if c not in keys and c not in columns]
    new = last_per_key(batch, keys, order)
    new = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys])
    both = stored.join(new, list(keys), "full")
    value = {c: F.coalesce(*[x for x in (
        F.col(f"_n_{c}") if f"_n_{c}" in new.columns else None, F.col(c) if c in stored.columns else None) if x is not None])
        for c in columns}
    return both.select(*keys, *[value[c].alias(c) for c in columns])


def merge_add(stored: DataFrame, batch: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add the batch's sums to the stored counters; the batch is summed before it is shuffled."""
    new = batch.groupBy(*keys).agg(*[F.sum(c).alias(f"_n_{c}") for c in sums])
    both = stored.join(new, list(keys), "full")
    zero = F.lit(0)
    added = {c: F.coalesce(F.col(c), zero) + F.coalesce(F.col(f"_n_{c}"), zero) for c in sums}
    return both.select(*[added[c].alias(c) if c in sums else F.col(c) for c in stored.columns])


def merge_children(parents: DataFrame, children: DataFrame, parent_key: str, child_id: str, array: str,
                   order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Put children into their parent's array: same id replaces, a new id is appended.

    Returns the parents and the children without one. Only the latest row per (parent, id) reaches
    the array; a parent row is as large as the document it stands for.
    """
    fields = [c for c in children.columns if c != parent_key]
    known = parents.select(parent_key)
    orphans = children.join(known, parent_key, "left_anti")
    latest = last_per_key(children, [parent_key, child_id], order)
    packed = latest.groupBy(parent_key).agg(
        F.array_sort(F.collect_list(F.struct(child_id, *[c for c in fields if c != child_id]))).alias("_new"))
    joined = parents.join(packed, parent_key, "left")
    ids = F.transform("_new", lambda x: x.getField(child_id))
    kept = F.filter(F.col(array), lambda x: ~F.array_contains(ids, x.getField(child_id)))
    merged = F.when(F.col("_new").isNull(), F.col(array)).when(F.col(array).isNull(), F.col("_new")) \
        .otherwise(F.concat(kept, F.col("_new")))
    return joined.withColumn(array, merged).drop("_new"), orphans
