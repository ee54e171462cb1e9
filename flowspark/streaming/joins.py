"""Window joins of two streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _side(df: DataFrame, on: Sequence[str], window: Column, prefix: str) -> DataFrame:
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(on)]
    # only the window keeps the watermark; a stream may carry one event time into a join
    plain = {f.name: F.timestamp_micros(F.unix_micros(f.name)) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
             for f in df.schema.fields}
    return df.select(window.alias("_w"), *keys, *[v.alias(f"{prefix}{c}") for c, v in plain.items()])


def window_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_ts: str, right_ts: str,
                size: str, slide: str | None = None, prefixes: tuple[str, str] = ("l_", "r_")) -> DataFrame:
    """Pairs of the two streams with equal keys in the same tumbling (or sliding) window.

    In a sliding window a pair comes out once per window both rows share. Watermarks of both sides
    bound the kept rows. Keys are compared as text, missing ones as "".
    """
    def win(ts):
        return F.window(ts, size, slide) if slide else F.window(ts, size)

    l = _side(left, [a for a, _ in on], win(left_ts), prefixes[0])
    r = _side(right, [b for _, b in on], win(right_ts), prefixes[1])
    keys = ["_w", *[f"_k{i}" for i in range(len(on))]]
    out = l.join(r, keys)
    return out.select(F.col("_w.start").alias("w_start"), F.col("_w.end").alias("w_end"),
                      *[c for c in l.columns if c not in keys], *[c for c in r.columns if c not in keys])
