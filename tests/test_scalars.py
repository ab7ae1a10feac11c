"""Value tables of the parsers."""

import datetime

import pytest
from pyspark.sql import functions as F

from horarium.functions import pyudfs
from horarium.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "pm", "want"), [
    ("1:30", None, "01:30"), ("1:30", True, "13:30"), ("11:45", True, "23:45"), ("12:05", False, "00:05"), ("1.30 pm", None, "13:30"), ("12:10am", None, "00:10"),
    ("25:00", None, None), ("13:30 pm", None, None), ("12:30 pm", None, "12:30"), ("123:45", None, "23:45"), ("10:75 9:00", None, None), ("٠٥:٣٠", None, "05:30"), ("", None, None), (None, None, None), ("soon", True, None),
])
def test_parse_time(spark, text, pm, want):
    assert one(spark, S.parse_time(F.lit(text).cast("string"), None if pm is None else F.lit(pm))) == want


@pytest.mark.parametrize(("text", "want"), [("+10", 10), ("−5", -5), ("10", None), ("10 min", 10), ("7mins.", 7), ("+1000", None), ("x", None), ("", None)])
def test_parse_offset(spark, text, want):
    assert one(spark, S.parse_offset(F.lit(text))) == want


@pytest.mark.parametrize(("text", "month", "want"), [
    ("2026-02-30", None, None), ("2026-06-01", None, "2026-06-01"), ("1/6", None, "2026-06-01"), ("1/6/27", None, "2027-06-01"), ("31.2.2026 1 May", None, None),
    ("1st June", None, "2026-06-01"), ("June 2nd", None, "2026-06-02"), ("3", None, None), ("3", 6, "2026-06-03"), ("Mon 4", 6, "2026-06-04"), ("5 Tue", 6, "2026-06-05"), ("5tue", 6, "2026-06-05"), ("12.05", None, "2026-05-12"), ("x", 6, None),
])
def test_parse_date(spark, text, month, want):
    got = one(spark, S.parse_date(F.lit(text), F.lit(2026), None if month is None else F.lit(month)))
    assert got == (want and datetime.date.fromisoformat(want))


def test_apply_offset_stays_within_the_day(spark):
    assert one(spark, S.apply_offset(F.lit("23:50"), F.lit(9))) == "23:59"
    assert one(spark, S.apply_offset(F.lit("23:50"), F.lit(10))) is None
    assert one(spark, S.apply_offset(F.lit("00:05"), F.lit(-6))) is None


def test_url_host(spark):
    for url, host in (("https://User:p@Www.Example.com:80/a?b", "www.example.com"), ("example.com/x", "example.com"), ("", "")):
        assert one(spark, S.url_host(F.lit(url))) == host


@pytest.mark.parametrize(("text", "want"), [("Fajr", ("fajr", 1.0, False)), ("Salat al Zuhr", ("dhuhr", 1.0, False)), ("Maghribb", ("maghrib", 0.6, True)), ("‘Ishā’", ("isha", 1.0, False)), ("", (None, 0.0, False)), ("zzzz", (None, 0.0, False))])
def test_resolve(text, want):
    assert pyudfs.resolve(text) == want


@pytest.mark.parametrize(("text", "want"), [('x {"a": "}"} y', '{"a": "}"}'), ("{1 {2} 3} 4", "{1 {2} 3}"), ("none", None), (None, None), ("{ open", None)])
def test_first_object(text, want):
    assert pyudfs.first_object(text) == want
