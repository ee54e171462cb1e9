"""Text columns: predicates, quoting-aware splits, tokens, numeric text, wildcards, name templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

C = F.col


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def like(c: str | Column, pattern: str) -> Column:
    """`%` counts only at the two ends; `_` and an inner `%` are plain characters."""
    col = as_col(c)
    left, right = pattern.startswith("%"), pattern.endswith("%") and len(pattern) > 1
    body = pattern[1 if left else 0: len(pattern) - 1 if right else len(pattern)]
    if left and right:
        return col.contains(F.lit(body))
    if left:
        return col.endswith(F.lit(body))
    if right:
        return col.startswith(F.lit(body))
    return col == F.lit(body)


def full_match(c: str | Column, pattern: str) -> Column:
    return as_col(c).rlike(f"^(?:{pattern})$")


_QUOTES_AHEAD = r"(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)(?=(?:[^']*'[^']*')*[^']*$)"


def split_outside_quotes(c: str | Column, delimiter: str) -> Column:
    return F.split(as_col(c), re.escape(delimiter) + _QUOTES_AHEAD)


def split_outside_quotes_and_brackets(c: str | Column, delimiter: str) -> Column:
    """Also leaves delimiters inside one level of `( )` alone."""
    return F.split(as_col(c), re.escape(delimiter) + r"(?![^(]*\))" + _QUOTES_AHEAD)


def replace_outside_quotes(c: str | Column, old: str, new: str) -> Column:
    return F.regexp_replace(as_col(c), F.lit(re.escape(old) + _QUOTES_AHEAD), F.lit(java_literal(new)))


def java_literal(text: str) -> str:
    """Text safe as a regex replacement."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def split_tokens(c: str | Column, separator: str) -> Column:
    """Pieces between matches of `separator`, without empty ones."""
    return F.filter(F.split(as_col(c), separator), lambda x: x != "")


def log_tokens(c: str | Column) -> Column:
    """Runs of letters and digits, runs of non-ASCII text, every other character alone."""
    return F.regexp_extract_all(as_col(c), F.lit(r"([0-9A-Za-z]+|[^\x00-\x7f]+|[\x00-\x7f])"), F.lit(1))


def numeric_text(c: str | Column, kind: str = "double") -> Column:
    """Number, or number with a ten-thousand suffix; anything else is null."""
    text = F.trim(as_col(c).cast("string"))
    base = F.regexp_extract(text, r"^([+-]?\d+(?:\.\d+)?)(?:万|w|W)?$", 1).try_cast("double")
    value = F.when(text.rlike("(?:万|w|W)$"), base * 10000).otherwise(base)
    return value if kind == "double" else F.when(value.isNotNull(), value.try_cast(kind))


def squash(c: str | Column) -> Column:
    """Any number into (-1, 1)."""
    return F.atan(as_col(c)) * 2 / F.pi()


def wildcard_regex(pattern: str) -> str:
    """`*` any text, `?` at most one character, `{a,b}` one of; a backslash takes the next sign as it is."""
    out, depth, at = [], 0, 0
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        elif sign == "*":
            out.append(".*")
        elif sign == "?":
            out.append(".?")
        elif sign == "{":
            depth += 1
            out.append("(?:")
        elif sign == "}" and depth:
            depth -= 1
            out.append(")")
        elif sign == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(sign))
        at += 1
    return "^" + "".join(out) + ")" * depth + "$"


def wildcard_match(c: str | Column, pattern: str) -> Column:
    return as_col(c).rlike(wildcard_regex(pattern))


def cut(c: str | Column, start: int, limit: int) -> Column:
    """From `start` on `limit` characters; a negative `start` drops the last `limit` characters."""
    col = as_col(c)
    if start >= 0:
        return F.when(F.length(col) < start, col).otherwise(F.substring(col, start + 1, limit))
    return F.when(F.length(col) < limit, col).otherwise(F.left(col, F.length(col) - limit))


def name_from(prefix: str, suffix: str, value: str | Column, how: str = "value", *, fmt: str = "yyyyMMdd",
              side: str = "start", start: int = 0, length: int = 0, mod: int = 10) -> Column:
    """Output name `prefix + part + suffix`; the part is made from a field, `default` when it is missing.

    `how`: value, date (with `fmt`), truncate (`length` characters from `start`, counted from
    `side`), mod (hash class), none.
    """
    col = as_col(value)
    if how == "none":
        return F.lit(prefix + suffix)
    if how == "value":
        part = col.cast("string")
    elif how == "date":
        part = F.date_format(col, fmt)
    elif how == "truncate":
        text = col.cast("string")
        if side == "start":
            part = F.substring(text, start + 1, length)
        else:
            keep = F.length(text) - start
            part = F.substring(F.left(text, keep), F.greatest(keep - length, F.lit(0)) + 1, F.lit(length))
    elif how == "mod":
        part = F.pmod(F.xxhash64(col.cast("string")), F.lit(mod)).cast("string")
    else:
        raise ValueError(f"unknown name part {how}")
    return F.concat(F.lit(prefix), F.coalesce(part, F.lit("default")), F.lit(suffix))


def to_text(c: str | Column, kind: str) -> Column:
    """A typed value as text, by SQL type name."""
    col = as_col(c)
    kind = kind.lower()
    if kind in ("date",):
        return F.date_format(col, "yyyy-MM-dd")
    if kind in ("time",):
        return F.date_format(col, "HH:mm:ss")
    if kind in ("timestamp", "datetime"):
        return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return col.cast("string")
