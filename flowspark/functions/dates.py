"""Calendar functions over timestamps, epoch numbers and formatted text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.functions.text import as_col


def long_to_date(ms: str | Column) -> Column:
    return F.to_date(F.timestamp_millis(as_col(ms)))


def date_to_long(ts: str | Column) -> Column:
    return F.coalesce(F.unix_millis(as_col(ts).cast("timestamp")), F.lit(0).cast("long"))


def parse_moment(c: str | Column) -> Column:
    """Text as `yyyy-MM-dd HH:mm:ss`, else `yyyy-MM-dd`, else `HH:mm:ss` (on 1970-01-01); null otherwise."""
    text = as_col(c)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), text), F.lit("yyyy-MM-dd HH:mm:ss")),
    )


def epoch_moment(c: str | Column) -> Column:
    """Epoch seconds, or milliseconds when the number has more than ten digits."""
    n = as_col(c).cast("long")
    return F.when(F.length(n.cast("string")) > 10, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))


def _epoch(ts: Column, scope: str) -> Column:
    ts = ts.cast("timestamp")
    return F.unix_millis(ts) if scope.upper() == "MS" else F.unix_seconds(ts)


def day_start(epoch: str | Column, scope: str = "MS") -> Column:
    return _epoch(F.date_trunc("day", epoch_moment(epoch)), scope)


def next_day_start(epoch: str | Column, scope: str = "MS") -> Column:
    return _epoch(F.date_trunc("day", epoch_moment(epoch)) + F.expr("INTERVAL 1 DAY"), scope)


def minute_start(epoch: str | Column, scope: str = "MS") -> Column:
    return _epoch(F.date_trunc("minute", epoch_moment(epoch)), scope)


def hour_start(epoch: str | Column, scope: str = "MS") -> Column:
    return _epoch(F.date_trunc("hour", epoch_moment(epoch)), scope)


def month_first(d: str | Column) -> Column:
    return F.trunc(as_col(d).cast("date"), "MM")


def first_day_of(year: str | Column, month: str | Column) -> Column:
    return F.make_date(as_col(year), as_col(month), F.lit(1))


def last_day_of(year: str | Column, month: str | Column) -> Column:
    return F.last_day(first_day_of(year, month))


def previous_month_first(d: str | Column) -> Column:
    return F.trunc(F.add_months(as_col(d).cast("date"), -1), "MM")


def previous_month_last(d: str | Column) -> Column:
    return F.last_day(F.add_months(as_col(d).cast("date"), -1))


def week_first(d: str | Column) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", as_col(d)))


def shifted_text(text: str | Column, fmt: str, days: int) -> Column:
    """A formatted day moved by some days; bad text is null."""
    moment = F.try_to_timestamp(as_col(text), F.lit(fmt))
    return F.date_format(moment + F.make_dt_interval(F.lit(days)), fmt)


def reformat(text: str | Column, old: str, new: str) -> Column:
    return F.date_format(F.try_to_timestamp(as_col(text), F.lit(old)), new)


def text_to_epoch(text: str | Column, fmt: str, scope: str = "MS") -> Column:
    return _epoch(F.try_to_timestamp(as_col(text), F.lit(fmt)), scope)


def epoch_to_text(epoch: str | Column, fmt: str) -> Column:
    return F.date_format(epoch_moment(epoch), fmt)


def days_back(ts: str | Column, n: int) -> Column:
    """Midnight of the day n days earlier."""
    return F.date_trunc("day", as_col(ts)) - F.make_dt_interval(F.lit(n))


def months_between_inclusive(a: str | Column, b: str | Column) -> Column:
    """Calendar months touched from a to b."""
    a, b = as_col(a), as_col(b)
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) + 1


def weeks_between_inclusive(a: str | Column, b: str | Column) -> Column:
    """Calendar weeks touched from a to b; a later year adds 52 weeks each."""
    a, b = as_col(a), as_col(b)
    return (F.year(b) - F.year(a)) * 52 + F.weekofyear(b) - F.weekofyear(a) + 1


def minutes_shift(ts: str | Column, n: int) -> Column:
    return as_col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))


def seconds_between(a: str | Column, b: str | Column) -> Column:
    return F.unix_seconds(as_col(b).cast("timestamp")) - F.unix_seconds(as_col(a).cast("timestamp"))


def guess_event_time(parts: dict[str, str | Column], now: str | Column) -> Column:
    """Event time from captured date parts (year, month, day, hour, minute, second).

    A two-digit year is in 20xx, a missing year is the year of `now`, and a result after `now`
    moves one year back. Month may be a number or an English name.
    """
    moment = as_col(now).cast("timestamp")

    def part(name, default):
        if name not in parts:
            return default
        return F.coalesce(as_col(parts[name]).cast("string").try_cast("int"), default)

    year = part("year", F.year(moment))
    year = F.when(year < 100, year + 2000).otherwise(year)
    month = F.month(moment)
    if "month" in parts:
        text = as_col(parts["month"]).cast("string")
        named = F.month(F.try_to_timestamp(F.concat(F.initcap(F.substring(text, 1, 3)), F.lit(" 2000")), F.lit("MMM yyyy")))
        month = F.coalesce(text.try_cast("int"), named)
    stamp = F.try_make_timestamp(year, month, part("day", F.dayofmonth(moment)), part("hour", F.lit(0)),
                                 part("minute", F.lit(0)), part("second", F.lit(0)).cast("decimal(16,6)"))
    return F.when(stamp > moment, stamp - F.expr("INTERVAL 1 YEAR")).otherwise(stamp)


def captured_time(columns: Sequence[str], now: str | Column) -> Column:
    """Event time from the columns a pattern with time parts captured (`_year`, `_month` or `_month_num`, `_hour` ...)."""
    have = {c: F.col(c) for c in columns}
    months = [have[c] for c in ("_month", "_month_num", "_month_num2") if c in have]
    parts = {"month": F.coalesce(*months)} if months else {}
    for part, column in (("year", "_year"), ("day", "_month_day"), ("hour", "_hour"), ("minute", "_minute")):
        if column in have:
            parts[part] = have[column]
    if "_second" in have:
        parts["second"] = F.regexp_extract(have["_second"], "^[0-9]+", 0)
    return guess_event_time(parts, now)
