import datetime as dt

from pyspark.sql import functions as F

from flowspark.functions import casts, dates, text


def val(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


def test_numeric_text(spark):
    def whole(t, k="integer"):
        return val(spark, casts.to_whole(F.lit(t), k))

    assert [whole(x) for x in ("1.2E2", ".2E2", "2E-2", "1.5", "2.4", "-1.5", "12")] == [120, 20, 0, 2, 2, -1, 12]
    assert whole("1.5", "short") == 2
    assert whole("100000000000") is None and whole("100000", "short") is None and whole("abc") is None
    assert [val(spark, casts.to_real(F.lit(x))) for x in ("1.2E2", ".2E2", "2E-2", "abc")] == [120.0, 20.0, 0.02, None]


def test_normalize_names_failures(spark):
    df = spark.createDataFrame([("5", "true", "x"), ("z", "maybe", "y")], "n string, b string, s string")
    rows = casts.normalize(df, [("n", "long"), ("b", "boolean"), ("absent", "long")]).collect()
    assert rows[0]["n"] == 5 and rows[0]["b"] is True and rows[0]["_error"] is None
    assert rows[1]["_error"] == "n is no long; b is no boolean" and rows[1]["_rejected"] == {"n": "z", "b": "maybe"}


def test_dates_by_magnitude(spark):
    base = dt.datetime(2018, 1, 1)
    s = 1514764800
    for n in (s * 10**9, s * 10**6, s * 1000):
        assert val(spark, casts.to_moment(F.lit(n), "", numeric=True)) == base
    assert val(spark, casts.to_moment(F.lit(str(s)), "yyyy")) == base
    assert val(spark, casts.to_moment(F.lit(str(s * 1000)), "yyyy")) == base
    assert val(spark, casts.to_moment(F.lit("01/01/2018"), "dd/MM/yyyy")) == base
    assert val(spark, casts.to_moment(F.lit("123"), "yyyy-MM-dd")) is None


def test_lists_bytes_addresses(spark):
    assert val(spark, casts.cast_to(F.array(F.lit("1"), F.lit("2.5"), F.lit("x")), "list[integer]")) == [1, 3, None]
    assert val(spark, casts.cast_to(F.lit("300"), "byte")) is None and val(spark, casts.cast_to(F.lit("12"), "byte")) == 12
    assert val(spark, casts.ip_to_long(F.lit("1.2.3.4"))) == 16909060
    assert [val(spark, casts.ip_to_long(F.lit(x))) for x in ("1.2.3", "1.2.3.256", "a.b.c.d")] == [-1, -1, -1]
    assert val(spark, casts.long_to_ip(F.lit(16909060))) == "1.2.3.4"


def test_like(spark):
    def hit(p):
        return val(spark, text.like(F.lit("中国a_b"), p))

    assert hit("%国%") and hit("中%") and hit("%b") and hit("中国a_b")
    assert not hit("中国aXb") and not hit("中国_") and not hit("国%")


def test_wildcards():
    import re

    def ok(p, s):
        return bool(re.match(text.wildcard_regex(p), s))

    assert ok("*.{log,txt}", "a.txt") and not ok("*.{log,txt}", "a.csv")
    assert ok("a?c", "abc") and ok("a?c", "ac") and not ok("a?c", "abbc")
    assert ok(r"a\*b", "a*b") and not ok(r"a\*b", "axb")


def test_quoted_splits(spark):
    assert val(spark, text.split_outside_quotes(F.lit("a,'b,c',\"d,e\",f"), ",")) == ["a", "'b,c'", '"d,e"', "f"]
    assert val(spark, text.split_outside_quotes_and_brackets(F.lit("f(a,b),c"), ",")) == ["f(a,b)", "c"]
    assert val(spark, text.replace_outside_quotes(F.lit("a b 'c b'"), "b", "$x")) == "a $x 'c b'"


def test_name_templates(spark):
    day = F.lit("2018-03-04 05:06:07").cast("timestamp")
    assert val(spark, text.name_from("logs_", "", day, "date")) == "logs_20180304"
    assert val(spark, text.name_from("logs_", ".x", F.lit("abcdefgh"), "truncate", side="end", start=0, length=5)) == "logs_defgh.x"
    assert val(spark, text.name_from("logs_", "", F.lit("abcdefgh"), "truncate", start=2, length=3)) == "logs_cde"
    assert val(spark, text.name_from("logs_", "", F.lit(None))) == "logs_default"
    assert 0 <= int(val(spark, text.name_from("", "", F.lit("abc"), "mod", mod=10))) < 10


def test_numeric_suffix_and_squash(spark):
    assert [val(spark, text.numeric_text(F.lit(x))) for x in ("3万", "1.5w", "2W", "7", "x7")] == [30000.0, 15000.0, 20000.0, 7.0, None]
    assert val(spark, text.numeric_text(F.lit("3万"), "int")) == 30000
    assert abs(val(spark, text.squash(F.lit(1.0))) - 0.5) < 1e-12


def test_calendar(spark):
    d = F.lit("2018-03-31").cast("date")
    assert val(spark, dates.previous_month_first(d)) == dt.date(2018, 2, 1)
    assert val(spark, dates.previous_month_last(d)) == dt.date(2018, 2, 28)
    assert val(spark, dates.last_day_of(F.lit(2020), F.lit(2))) == dt.date(2020, 2, 29)
    assert val(spark, dates.week_first(F.lit("2018-03-31").cast("timestamp"))) == dt.date(2018, 3, 26)
    assert val(spark, dates.months_between_inclusive(F.lit("2017-11-30").cast("date"), F.lit("2018-02-01").cast("date"))) == 4
    assert val(spark, dates.shifted_text(F.lit("2018-03-01"), "yyyy-MM-dd", -1)) == "2018-02-28"
    assert val(spark, dates.shifted_text(F.lit("bad"), "yyyy-MM-dd", -1)) is None
    assert val(spark, dates.parse_moment(F.lit("05:06:07"))) == dt.datetime(1970, 1, 1, 5, 6, 7)
    assert val(spark, dates.date_to_long(F.lit(None).cast("timestamp"))) == 0


def test_epoch_starts(spark):
    ms = 1514768461000  # 2018-01-01 01:01:01
    assert val(spark, dates.day_start(F.lit(ms))) == 1514764800000
    assert val(spark, dates.next_day_start(F.lit(ms // 1000), "S")) == 1514851200
    assert val(spark, dates.minute_start(F.lit(ms))) == 1514768460000
    assert val(spark, dates.hour_start(F.lit(ms), "S")) == 1514768400


def test_event_time_guess(spark):
    now = F.lit("2018-06-15 12:00:00")
    assert val(spark, dates.guess_event_time({"month": F.lit("Jun"), "day": F.lit("14")}, now)) == dt.datetime(2018, 6, 14)
    assert val(spark, dates.guess_event_time({"month": F.lit("12"), "day": F.lit("1")}, now)) == dt.datetime(2017, 12, 1)
    assert val(spark, dates.guess_event_time({"year": F.lit("17"), "month": F.lit("2"), "day": F.lit("3"), "hour": F.lit("4")}, now)) == dt.datetime(2017, 2, 3, 4)
