"""Lookups in reference tables: by key, by address range, by prefix, by condition; missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.casts import ip_to_long
from flowspark.plans.scale import carry, checkpoint, first_per_key, lookup_join, ordered, salted_join


def lookup(df: DataFrame, table: DataFrame, column: str, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Copy the columns of the matching reference row. One row per key counts, the lowest by
    `order`; a name the record has already becomes `name_<column>`; no match leaves the row as it is."""
    order = list(order) or [c for c in table.columns if c != key]
    one = first_per_key(table.where(F.col(key).isNotNull()), [key], order)
    names = {c: (f"{c}_{column}" if c in df.columns else c) for c in one.columns if c != key}
    dim = one.select(F.col(key).alias(column), *[F.col(c).alias(n) for c, n in names.items()])
    return lookup_join(df, dim, [column], bound=table).select(*df.columns, *names.values())


def dictionary(df: DataFrame, table: DataFrame, column: str, key: str, prefix: str | None = None) -> DataFrame:
    """Dictionary columns under `prefix_name` (by default the looked-up column's name)."""
    prefix = prefix or column
    one = first_per_key(table, [key], [c for c in table.columns if c != key])
    dim = one.select(F.col(key).alias(column), *[F.col(c).alias(f"{prefix}_{c}") for c in one.columns if c != key])
    return lookup_join(df, dim, [column], bound=table).select(*df.columns, *[c for c in dim.columns if c != column])


def region_by_prefix(df: DataFrame, number: str, regions: DataFrame, code: str, digits: int = 6) -> DataFrame:
    """Region row by the first digits of an id-card or phone number."""
    keyed = df.withColumn("_code", F.substring(F.col(number).cast("string"), 1, digits))
    one = first_per_key(regions, [code], [c for c in regions.columns if c != code])
    dim = one.select(F.col(code).cast("string").alias("_code"),
                     *[F.col(c).alias(f"{number}_{c}") for c in one.columns if c != code])
    return lookup_join(keyed, dim, ["_code"]).select(*df.columns, *[c for c in dim.columns if c != "_code"])


# -- ranges ---------------------------------------------------------------------------

def range_matches(points: DataFrame, point: str, ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """All (point, range) pairs with `lo <= point <= hi`, whole numbers, as an equi join.

    A range of width up to 2^L touches at most two cells of size 2^L, so it is filed under these;
    a point looks into one cell per level in use (at most 63).
    """
    width = F.col(hi) - F.col(lo) + 1
    level = F.greatest(F.ceil(F.log2(width.cast("double"))), F.lit(0)).cast("int")
    filed = ranges.where(F.col(hi) >= F.col(lo)).withColumn("_level", level)
    cell = F.expr(f"shiftright(CAST(`{lo}` AS BIGINT), _level)"), F.expr(f"shiftright(CAST(`{hi}` AS BIGINT), _level)")
    filed = filed.withColumn("_cell", F.explode(F.array_distinct(F.array(*cell))))
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect())
    if not levels:
        levels = [0]
    probe = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels])))
    probe = probe.withColumn("_cell", F.expr(f"shiftright(CAST(`{point}` AS BIGINT), _level)"))
    hits = lookup_join(probe, filed, ["_level", "_cell"], "inner")
    return hits.where(F.col(point).between(F.col(lo), F.col(hi))).drop("_level", "_cell")


def range_lookup(df: DataFrame, point: str, ranges: DataFrame, lo: str, hi: str,
                 order: Sequence[str] = ()) -> DataFrame:
    """Columns of the range a point lies in (the lowest by `order` of several); left rows all stay.

    Each distinct point is resolved once, then its result is joined back to the rows.
    """
    points = df.select(point).where(F.col(point).isNotNull()).distinct()
    found = first_per_key(range_matches(points, point, ranges, lo, hi), [point], list(order) or [lo, hi])
    return lookup_join(df, checkpoint(found), [point])


# Private and loopback address blocks, which have no location.
PRIVATE_RANGES = (("10.0.0.0", "10.255.255.255"), ("172.16.0.0", "172.31.255.255"),
                  ("192.168.0.0", "192.168.255.255"), ("127.0.0.0", "127.255.255.255"))


def _number(ip: str) -> int:
    a, b, c, d = (int(x) for x in ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def ip_location(df: DataFrame, ip: str, ranges: DataFrame, lo: str, hi: str,
                custom: DataFrame | None = None, custom_key: str = "ip") -> DataFrame:
    """Location of an IPv4 address: private ranges none, a user dictionary first, then the range table."""
    fields = [c for c in ranges.columns if c not in (lo, hi)]
    number, private = F.col("_number"), F.lit(False)
    for first, last in PRIVATE_RANGES:
        private = private | number.between(_number(first), _number(last))
    keyed = df.withColumn("_number", ip_to_long(ip)).withColumn("_ip", F.when((number >= 0) & ~private, number))
    out = range_lookup(keyed.drop("_number"), "_ip", ranges, lo, hi).drop("_ip", lo, hi)
    named = {f: f"{ip}_{f}" for f in fields}
    out = out.select(*df.columns, *[F.col(f).alias(n) for f, n in named.items()])
    if custom is None:
        return out
    own = dictionary(out, custom.select(custom_key, *[c for c in fields if c in custom.columns]), ip, custom_key, "_own")
    chosen = {n: F.coalesce(F.col(f"_own_{f}"), F.col(n)) for f, n in named.items() if f in custom.columns}
    return own.withColumns(chosen).select(*out.columns)


# -- condition lookups ------------------------------------------------------------------

def condition_lookup(df: DataFrame, table: DataFrame, condition: Column | str, order: Sequence[str],
                     row_id: str, keys: Sequence[str] = (), between: tuple[str, str, str] | None = None,
                     below: tuple[str, str] | None = None) -> DataFrame:
    """The best reference row (lowest by `order`) that satisfies a free condition with a record.

    Records are the columns of `df`, reference columns carry their own names. The condition needs an
    anchor, so that no cross product arises: equal `keys`, or `between` = (point, lo, hi). With `keys`, every
    pair of equal keys is looked at, unless `below` = (column, limit) says that the condition is just
    `column < limit`, of one type, and that `order` puts the greatest `column` first: such a record
    meets its best rows only.
    """
    cond = F.expr(condition) if isinstance(condition, str) else condition
    extra = [c for c in table.columns if c not in keys]
    if keys and below:
        hits = _best_below(df, table, list(keys), below[0], below[1], order, row_id)
    elif keys:
        hits = salted_join(df, table, list(keys), "inner").where(cond)
    elif between:
        hits = range_matches(df, between[0], table, between[1], between[2]).where(cond)
    else:
        raise ValueError("a condition lookup needs keys or a between anchor")
    best = first_per_key(hits.select(row_id, *extra), [row_id], order)
    return df.join(best, row_id, "left")


def _best_below(df: DataFrame, table: DataFrame, keys: list[str], column: str, limit: str, order: Sequence[str],
                row_id: str) -> DataFrame:
    """`row_id` of each record with the reference rows of its keys that have the greatest `column` below its limit, of these
    the lowest by `order` (several where they differ in other columns only).

    Reference rows and records lie in one line per key, by `column` and limit; a record takes the last rows before it. The
    line is cut into range slices, so a key of any size is spread over tasks.
    """
    extra = [c for c in table.columns if c not in keys]
    rows = table.dropna(subset=[*keys, column])
    equal = rows.groupBy(*dict.fromkeys([*keys, column, *order])).agg(F.collect_set(F.struct(*extra)).alias("_rows"))
    lowest = equal.groupBy(*keys, column).agg(F.min_by("_rows", F.struct(*order)).alias("_rows"))
    spots = lowest.select(*keys, F.col(column).alias("_at"), F.lit(1).alias("_side"), "_rows")
    asked = df.select(*keys, F.expr(limit).alias("_at"), F.lit(0).alias("_side"), F.col(row_id).alias("_id"))
    line = spots.unionByName(asked.dropna(subset=[*keys, "_at"]), allowMissingColumns=True)
    placed = carry(ordered(line, keys, ["_at", "_side"]), keys, {"_best": ("_rows", "previous")})
    found = placed.where("_side = 0").select(F.col("_id").alias(row_id), F.explode("_best").alias("_row"))
    return found.select(row_id, *[F.col("_row").getField(c).alias(c) for c in extra])


def cached_dimension(df: DataFrame) -> DataFrame:
    """A reference table written once and read by several jobs."""
    return checkpoint(df)


# -- missing values ----------------------------------------------------------------------

def fill_missing(df: DataFrame, columns: Sequence[str], mode: str = "zero") -> DataFrame:
    """Missing numbers become 0 or the column's average (one aggregate row)."""
    if mode == "zero":
        return df.fillna(0, subset=list(columns))
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns})
