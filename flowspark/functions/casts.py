"""Typed values from loose text: numbers, booleans, dates, lists, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.text import as_col

INTEGER = r"^[+-]?\d+$"
DECIMAL = r"^[+-]?\d*\.\d+$|^[+-]?\d+\.$"
SCIENTIFIC = r"^[+-]?\d+(?:\.\d+)?[eE][+-]?\d+$"
WHOLE = {"integer": "int", "int": "int", "long": "bigint", "short": "smallint"}


def _number_text(c: str | Column) -> Column:
    text = F.trim(as_col(c).cast("string"))
    return F.when(text.startswith("."), F.concat(F.lit("0"), text)).otherwise(text)


def to_whole(c: str | Column, kind: str = "integer") -> Column:
    """Decimals are rounded half up, scientific notation is cut off, other text is null."""
    text, target = _number_text(c), WHOLE[kind]
    return (
        F.when(text.rlike(INTEGER), text.try_cast(target))
        .when(text.rlike(DECIMAL), F.floor(text.try_cast("double") + 0.5).try_cast(target))
        .when(text.rlike(SCIENTIFIC), text.try_cast("double").try_cast("bigint").try_cast(target))
    )


def to_real(c: str | Column, kind: str = "double") -> Column:
    text = _number_text(c)
    shaped = text.rlike(INTEGER) | text.rlike(DECIMAL) | text.rlike(SCIENTIFIC)
    return F.when(shaped, text.try_cast(kind))


def to_bool(c: str | Column) -> Column:
    """true/false/1/0; other values give null (kept as they are by `normalize`)."""
    text = F.lower(F.trim(as_col(c).cast("string")))
    return F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False))


def to_moment(c: str | Column, fmt: str, numeric: bool = False) -> Column:
    """Date by format; epoch numbers by their size (ns, µs, ms, else seconds above 1e10).

    Digit text of 13 or more places is milliseconds, of 10 to 12 places seconds.
    """
    if numeric:
        n = as_col(c).cast("bigint")
        ms = (
            F.when((n >= 10**18), F.floor(n / 10**6))
            .when((n >= 10**15) & (n < 10**16), F.floor(n / 1000))
            .when((n >= 10**12) & (n < 10**13), n)
            .when(n > 10**10, n * 1000)
        )
        return F.timestamp_millis(ms.cast("bigint"))
    text = F.trim(as_col(c).cast("string"))
    digits = text.rlike(r"^\d+$")
    n = F.when(digits, text.try_cast("bigint"))
    return (
        F.when(digits & (F.length(text) >= 13), F.timestamp_millis(n))
        .when(digits & (F.length(text) >= 10), F.timestamp_seconds(n))
        .when(~digits, F.try_to_timestamp(text, F.lit(fmt)))
    )


def cast_to(c: str | Column, kind: str, fmt: str | None = None) -> Column:
    """A column cast to one of the metadata types; null where the value does not fit."""
    kind = kind.lower()
    if kind.startswith("list[") and kind.endswith("]"):
        return F.transform(as_col(c), lambda x: cast_to(x, kind[5:-1], fmt))
    if kind in WHOLE:
        return to_whole(c, kind)
    if kind in ("double", "float"):
        return to_real(c, kind)
    if kind == "boolean":
        return to_bool(c)
    if kind == "byte":
        return as_col(c).cast("string").try_cast("tinyint")
    if kind in ("date", "datetime"):
        return to_moment(c, fmt or "yyyy-MM-dd HH:mm:ss")
    if kind == "string":
        return as_col(c).cast("string")
    raise ValueError(f"unknown type {kind}")


def to_json_text(df: DataFrame, name: str) -> Column:
    """Text of any column: strings as they are, nested values as JSON."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("struct", "map", "array", "variant"):
        return F.to_json(F.col(name))
    return F.col(name).cast("string")


def normalize(df: DataFrame, metadata: list[tuple]) -> DataFrame:
    """Cast columns by `(name, type[, format])`; a value that does not fit is named in `_error`.

    The text of such a value stays in `_rejected` (name -> text), since a typed column cannot hold it.
    """
    cast, errors, rejected = {}, [], []
    for entry in metadata:
        name, kind, fmt = (*entry, None)[:3]
        if name not in df.columns:
            continue
        source = to_json_text(df, name) if kind == "string" else F.col(name)
        cast[name] = source if kind == "string" else cast_to(name, kind, fmt)
        failed = F.col(name).isNotNull() & cast[name].isNull()
        errors.append(F.when(failed, F.lit(f"{name} is no {kind}")))
        rejected.append(F.when(failed, F.struct(F.lit(name).alias("key"), to_json_text(df, name).alias("value"))))
    if not cast:
        return df
    previous = [F.col("_error")] if "_error" in df.columns else []
    message = F.concat_ws("; ", *previous, *errors)
    kept = F.map_from_entries(F.filter(F.array(*rejected), lambda x: x.isNotNull()))
    return df.withColumns({
        **cast,
        "_error": F.when(message != "", message),
        "_rejected": F.when(F.size(kept) > 0, kept),
    })


IPV4 = r"^(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|[01]?\d?\d)){3}$"


def ip_to_long(c: str | Column) -> Column:
    """IPv4 text as a number, -1 when it is none."""
    text = F.trim(as_col(c))
    number = F.aggregate(F.split(text, r"\."), F.lit(0).cast("bigint"), lambda a, o: a * 256 + o.try_cast("bigint"))
    return F.when(text.rlike(IPV4), number).otherwise(F.lit(-1).cast("bigint"))


def long_to_ip(c: str | Column) -> Column:
    n = as_col(c).cast("bigint")
    return F.concat_ws(".", *[F.shiftrightunsigned(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
