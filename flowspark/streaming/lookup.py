"""Streams enriched from reference tables, and streams scored by models, one micro-batch at a time."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from flowspark.operators.enrich import lookup
from flowspark.plans.scale import lookup_join
from flowspark.plans.sql import run_sql

Write = Callable[[DataFrame, int], None]


class Refreshed:
    """A table loaded again when it is older than `seconds`."""

    def __init__(self, load: Callable[[], DataFrame], seconds: float = 60):
        self.load, self.seconds = load, seconds
        self._table: DataFrame | None = None
        self._at = 0.0

    def get(self) -> DataFrame:
        if self._table is None or time.time() - self._at > self.seconds:
            if self._table is not None:
                self._table.unpersist()
            self._table = self.load().cache()
            self._at = time.time()
        return self._table


def full_lookup(table: Refreshed, keys: Sequence[str], write: Write, how: str = "left") -> Write:
    """Join every micro-batch to the whole reference table; several matches give several rows.

    The stream is on the left; only inner and left joins exist.
    """
    if how not in ("inner", "left"):
        raise ValueError("a reference table can only be joined inner or left, and on the right")

    def step(batch: DataFrame, number: int) -> None:
        write(lookup_join(batch, table.get(), list(keys), how), number)

    return step


def keyed_lookup(load: Callable[[], DataFrame], column: str, key: str, write: Write) -> Write:
    """Look up only the keys of the micro-batch: distinct keys, a semi join to the reference
    table, then a left join. Keys without a match keep null columns."""

    def step(batch: DataFrame, number: int) -> None:
        table = load()
        wanted = batch.select(batch[column].alias(key)).distinct()
        write(lookup(batch, table.join(wanted, key, "left_semi"), column, key), number)

    return step


def side_sql(sql: str, stream_name: str, tables: dict[str, Callable[[SparkSession], DataFrame]], write: Write) -> Write:
    """SQL over the micro-batch and reference tables. Tables are loaded in the micro-batch's own
    session, where the SQL looks for them."""

    def step(batch: DataFrame, number: int) -> None:
        write(run_sql({stream_name: batch, **{n: load(batch.sparkSession) for n, load in tables.items()}}, sql), number)

    return step


def scored(model: Refreshed, score: Callable[[DataFrame, DataFrame], DataFrame], write: Write) -> Write:
    """Score every micro-batch with the newest model."""

    def step(batch: DataFrame, number: int) -> None:
        write(score(batch, model.get()), number)

    return step
