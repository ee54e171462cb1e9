"""Output text formats, content routing, file layouts, idempotent stream writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.rules import predicate


def _text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return col.cast("string")


def _is_date(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _quoted(df: DataFrame, name: str, delimiter: str) -> Column:
    text = _text(df, name)
    shut = F.concat(F.lit("'"), text, F.lit("'"))
    return shut if _is_date(df, name) else F.when(text.contains(delimiter), shut).otherwise(text)


def json_text(df: DataFrame) -> Column:
    """One JSON object; a lone `raw` column stays plain text."""
    if df.columns == ["raw"]:
        return F.col("raw").cast("string")
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def xml_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    def tag(name):
        body = _text(df, name)
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            body = F.replace(body, F.lit(sign), F.lit(entity))
        return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))

    return F.concat_ws("", *[tag(c) for c in columns or df.columns])


def delimited_text(df: DataFrame, delimiter: str, columns: Sequence[str] | None = None) -> Column:
    """Values with the delimiter inside, and dates, stand in single quotes; missing ones are empty."""
    return F.concat_ws(delimiter, *[F.coalesce(_quoted(df, c, delimiter), F.lit("")) for c in columns or df.columns])


def key_value_text(df: DataFrame, delimiter: str, tab: str, columns: Sequence[str] | None = None) -> Column:
    return F.concat_ws(delimiter, *[F.concat(F.lit(c + tab), _quoted(df, c, delimiter)) for c in columns or df.columns])


def syslog_text(body: Column, ts: Column, host: Column, tag: Column | None = None, facility: int = 1,
                level: int | Column = 6) -> Column:
    """`<pri>MMM dd HH:mm:ss host [tag] body`, pri = facility * 8 + level."""
    severity = F.lit(level) if isinstance(level, int) else level
    pri = (F.lit(facility * 8) + severity).cast("string")
    parts = [F.concat(F.lit("<"), pri, F.lit(">"), F.date_format(ts, "MMM dd HH:mm:ss")), host]
    if tag is not None:
        parts.append(F.concat(F.lit("["), tag, F.lit("]")))
    return F.concat_ws(" ", *parts, body)


def route_of(subject: Column, rules: Sequence[tuple[str, str, str]], default: str = "default") -> Column:
    """Route name of a row: the first (kind, value, route) that holds, else the default."""
    route = F.lit(default)
    for kind, value, name in reversed(list(rules)):
        route = F.when(predicate(kind, subject, value), F.lit(name)).otherwise(route)
    return route


def write_routed(df: DataFrame, subject: Column, rules: Sequence[tuple[str, str, str]],
                 writers: dict[str, Callable[[DataFrame], None]], default: str = "default") -> None:
    """Give every row to exactly one writer. Rows are written once to the checkpoint folder, so the
    input is not computed again per route."""
    from flowspark.plans.scale import checkpoint

    routed = checkpoint(df.withColumn("_route", route_of(subject, rules, default)))
    for name, write in writers.items():
        write(routed.where(F.col("_route") == name).drop("_route"))


def write_named_files(df: DataFrame, path: str, name: Column, kind: str = "json", mode: str = "append") -> None:
    """One folder per templated name."""
    df.withColumn("_name", name).write.mode(mode).partitionBy("_name").format(kind).save(path)


def write_orc(df: DataFrame, path: str, schema: T.StructType, mode: str = "append") -> None:
    """ORC files with a declared struct; other columns are left out."""
    out = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
           else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    df.select(*out).write.mode(mode).orc(path)


def console(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)


def write_once(path: str, kind: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` writer that can be repeated: a batch owns the folder `batch=<id>` and
    replaces it, and the stream's checkpoint advances only after the write."""

    def step(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").format(kind).save(f"{path}/batch={batch}")

    return step
