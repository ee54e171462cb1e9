"""Aggregates, row numbers, sets, metric roll-ups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.plans.scale import carry, join_back, ordered, settle


def percent_rank_mean(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str = "percent_rank") -> DataFrame:
    """Mean of the sorted values around the p-quantile, per key.

    With n values (index from 0), lo = ceil((n-1)(p-0.01)) and hi = floor(n(p+0.01)): equal bounds
    give that value; neighbours give their mean, or the lower one when the upper lies past the end;
    otherwise the mean of the values strictly between. No values give 0.
    """
    if not 0 <= p <= 1:
        raise ValueError("the rank has to be between 0 and 1")
    groups = df.groupBy(*keys).agg(F.count(value).alias("_all"))
    # equal values are one row with a count, so a value that most rows have is one row too
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_times"))
    placed = carry(ordered(counted, keys, [value]), keys, {"_upto": ("_times", "sum")})
    lo = F.ceil((F.col("_all") - 1) * F.lit(p - 0.01)).cast("long")
    hi = F.floor(F.col("_all") * F.lit(p + 0.01)).cast("long")
    pair = hi - lo == 1
    first = F.when((lo == hi) | pair, lo).otherwise(lo + 1)
    last = F.when(lo == hi, hi).when(pair & (hi >= F.col("_all")), lo).when(pair, hi).otherwise(hi - 1)
    inside = F.greatest(F.lit(0), F.least(last, F.col("_upto") - 1) - F.greatest(first, F.col("_upto") - F.col("_times")) + 1)
    taken = join_back(placed, groups, keys) if keys else placed.withColumn("_all", F.lit(groups.first()["_all"]))
    means = taken.withColumn("_inside", inside).groupBy(*keys).agg(
        (F.sum(F.col(value) * F.col("_inside")) / F.nullif(F.sum("_inside"), F.lit(0))).alias("_mean"))
    cond = F.lit(True)
    renamed = means.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "_mean")
    for k in keys:
        cond = cond & groups[k].eqNullSafe(renamed[f"_m_{k}"])
    return groups.join(renamed, cond, "left").select(
        *keys, F.when(F.col("_all") == 0, F.lit(0.0)).otherwise(F.col("_mean")).alias(name))


def row_index(df: DataFrame, order: Sequence[str], name: str = "index", keys: Sequence[str] = ()) -> DataFrame:
    """0-based place of every row in the whole table (or in its key)."""
    return settle(ordered(df, keys, order).withColumn(name, F.col("_pos") - 1))


def half_split(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """First half by order for training (index <= n/2), the rest for tests."""
    placed = ordered(df, keys, order)
    train = F.col("_pos") - 1 <= F.floor(F.col("_n") / 2)
    return settle(placed.where(train)), settle(placed.where(~train))


def series_per_key(df: DataFrame, keys: Sequence[str], time: str, value: str, grain: str) -> DataFrame:
    """Values of a key as one list in time order, averaged per time grain first, so that the list
    is as long as the calendar, not as the data."""
    slots = df.groupBy(*keys, F.date_trunc(grain, time).alias("_t")).agg(F.avg(value).alias("_v"))
    packed = slots.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_t", "_v"))).alias("_s"))
    return packed.select(*keys, F.transform("_s", lambda x: x.getField("_v")).alias("series"),
                         F.get("_s", F.lit(0)).getField("_t").alias("start"))


def tumbling(df: DataFrame, ts: str, width: str, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Group window with start and end."""
    grouped = df.groupBy(F.window(F.col(ts).cast("timestamp"), width).alias("_w"), *keys)
    out = grouped.agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("_w.start").alias("w_start"), F.col("_w.end").alias("w_end"), *keys, *aggs)


def complement(df: DataFrame, field: str, cases: Sequence[Column]) -> DataFrame:
    """Rows that match no case; a missing field matches none."""
    hit = F.lit(False)
    for case in cases:
        hit = hit | F.coalesce(case, F.lit(False))
    return df.where(F.col(field).isNull() | ~hit)


# -- metrics -----------------------------------------------------------------------------

def channel_counts(df: DataFrame, phase) -> DataFrame:
    """Observe how many rows went in, succeeded, failed and were ignored while `df` is written.

    `phase` is a name (read, operation, write) or an Observation.
    """
    error = F.col("_error").isNotNull() if "_error" in df.columns else F.lit(False)
    ignored = F.col("_ignored") if "_ignored" in df.columns else F.lit(False)
    return df.observe(phase, F.count(F.lit(1)).alias("in"), F.count_if(~error & ~ignored).alias("success"),
                      F.count_if(error).alias("fail"), F.count_if(ignored).alias("ignore"))


def roll_up(df: DataFrame, metric: str, ts: str, extract: str, width: str) -> DataFrame:
    """Per metric and interval keep the rows with the lowest, middle and highest extract value.

    Rows with equal values collapse to the earliest; up to two rows are all kept. Ordering happens
    over range slices, so one busy metric is not sorted by one task.
    """
    slot = F.window(F.col(ts).cast("timestamp"), width)["start"]
    rest = [c for c in df.columns if c not in (metric, extract)]
    keyed = df.withColumn("_slot", slot)
    unique = (
        keyed.groupBy(metric, "_slot", extract)
        .agg(F.min(F.struct(ts, *[c for c in rest if c != ts])).alias("_r"))
        .select(metric, "_slot", extract, *[F.col("_r").getField(c).alias(c) for c in rest])
    )
    placed = ordered(unique, [metric, "_slot"], [extract])
    middle = F.floor((F.col("_n") - 1) / 2) + 1
    keep = (F.col("_n") <= 2) | F.col("_pos").isin(1) | (F.col("_pos") == middle) | (F.col("_pos") == F.col("_n"))
    return settle(placed.where(keep)).withColumnRenamed("_slot", "slot")


def choose_level(df: DataFrame, ts: str, start, end, minimum: int, maximum: int) -> str:
    """Table to read for a range: hours above `maximum` minute rows, seconds up to `minimum`, else minutes."""
    n = df.where(F.col(ts).between(F.lit(start), F.lit(end))).count()
    return "hour" if n > maximum else "second" if n <= minimum else "minute"


def thin_out(df: DataFrame, metric: str, ts: str, parts: int, max_rows: int) -> DataFrame:
    """A long range as one middle row per metric and part.

    The range is cut into thirds, empty thirds are dropped, and so on until there are at least
    `parts` parts. Up to `max_rows` rows are returned as they are.
    """
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    stat = df.agg(F.count(F.lit(1)).alias("n"), F.min(ms).alias("a"), F.max(ms).alias("b")).first()
    if stat["n"] <= max_rows:
        return df
    width, base, part = stat["b"] - stat["a"], F.lit(stat["a"]), F.lit(0).cast("long")
    for _ in range(max(1, math.ceil(math.log(max(parts, 2), 3)) * 4)):
        width = width // 3
        digit = F.least(F.floor((ms - base) / F.lit(max(width, 1))), F.lit(2)).cast("long")
        part, base = part * 3 + digit, base + digit * width
        if width <= 1 or df.select(part.alias("p")).distinct().count() >= parts:
            break
    placed = ordered(df.withColumn("_part", part), [metric, "_part"], [ts])
    return settle(placed.where(F.col("_pos") == F.floor(F.col("_n") / 2) + 1)).drop("_part")


def retain_after(df: DataFrame, ts: str, cutoff) -> DataFrame:
    """Rows on or after the cutoff; write them back with dynamic partition overwrite."""
    return df.where(F.col(ts) >= F.lit(cutoff))
