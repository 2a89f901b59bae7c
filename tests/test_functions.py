import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspan.config import ModelSettings, StudyScope
from tallyspan.functions import calendar as cal
from tallyspan.functions import numeric, text
from tallyspan.functions.hashing import content_signature


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,expected", [
    ("1", 1), ("1.0", 1), (" 12 ", 12), ("1.5", None), ("true", None), ("1d", None), ("NaN", None), ("", None), (None, None), ("-4", -4), ("1e3", 1000),
])
def test_strict_integer(spark, raw, expected):
    assert one(spark, text.strict_integer(F.col("x").cast("string")), x=raw) == expected


@pytest.mark.parametrize("raw,expected", [("January", 1), (" dec ", 12), ("Sept", None), ("7", 7), ("13", None), ("0", None), ("MAY", 5)])
def test_month_number(spark, raw, expected):
    assert one(spark, text.month_number(F.col("x")), x=raw) == expected


@pytest.mark.parametrize("raw,code,error", [
    (" a00 – a09 ", "A00-A09", None), ("B00—A00", "B00-A00", "reversed_range"), ("A9", "A9", "bad_pattern"), ("A10-A19", "A10-A19", "outside_pool"),
])
def test_block_code(spark, raw, code, error):
    found = text.block_code(F.col("x"))
    assert one(spark, found, x=raw) == code
    assert one(spark, text.block_code_error(found, ["A00-A09"]), x=raw) == error


def plain_week_one(year):
    january = dt.date(year, 1, 1)
    sunday = january - dt.timedelta(days=(january.weekday() + 1) % 7)
    return sunday if 7 - (january - sunday).days >= 4 else sunday + dt.timedelta(7)


def test_reporting_calendar_against_plain_dates(spark):
    found = spark.range(1900, 2100).select(
        F.col("id").alias("y"), cal.first_week_start(F.col("id")).alias("w"), cal.year_length(F.col("id")).alias("n")
    ).collect()
    for row in found:
        assert row.w == plain_week_one(row.y)
        assert row.n == (plain_week_one(row.y + 1) - plain_week_one(row.y)).days // 7


def test_iso_weeks_against_plain_dates(spark):
    df = spark.range(1990, 2030).select(F.col("id").alias("y"), F.explode(F.expr("sequence(1L, 54L)")).alias("w"))
    for row in df.select("y", "w", cal.iso_week_month_index(F.col("y"), F.col("w")).alias("m")).collect():
        try:
            day = dt.date.fromisocalendar(row.y, row.w, 4)
            expected = day.year * 12 + day.month - 1
        except ValueError:
            expected = row.y * 12 + 11 if row.w == 53 else None
        assert row.m == expected


def test_advance_week_crosses_years_and_stops_at_the_unknown(spark):
    year, week = cal.advance_week(F.col("y"), F.col("w"), F.col("s"), F.lit(2019))
    df = spark.createDataFrame([(2019, 52, 1), (2019, 51, 1), (2019, 52, 53), (2019, 52, 54)], "y long, w long, s long")
    # 2020 has 53 weeks; the length of 2021 is not known
    assert [tuple(r) for r in df.select(year, week).collect()] == [(2020, 1), (2019, 52), (2020, 53), (None, None)]


def test_floors_and_clips_keep_unknown_values_unknown(spark):
    null = F.lit(None).cast("double")
    assert one(spark, numeric.floor_zero(null), x=1) is None
    assert one(spark, numeric.clip(null, 1.0), x=1) is None
    assert one(spark, numeric.combine(F.lit(2.0), null, 1.0, 0.1), x=1) is None
    assert one(spark, numeric.combine(F.lit(2.0), F.lit(-3.0), 1.0, 0.1), x=1) == pytest.approx(1.9)
    assert one(spark, numeric.combine_unbounded(F.lit(2.0), F.lit(-3.0)), x=1) == 0.0


def test_signature_ignores_order_and_partitions_but_sees_every_change(spark):
    data = [("a", 1, 5), ("a", 2, None), ("b", 1, 0)]
    schema = "k string, m long, y long"
    mark = lambda d, parts: content_signature(spark.createDataFrame(d, schema).repartition(parts), ["k", "m", "y"]).first()["content_signature"]
    base = mark(data, 1)
    assert base == mark(data[::-1], 3)
    assert base != mark([("a", 1, 5), ("a", 2, 0), ("b", 1, 0)], 1)
    assert base != mark(data + [("b", 1, 0)], 1)
    assert mark([("a1", 1, 5)], 1) != mark([("a", 11, 5)], 1)


def test_settings_are_checked():
    assert ModelSettings().signature == ModelSettings().signature
    assert ModelSettings().signature != ModelSettings(lags=6).signature
    for bad in ({"lags": 0}, {"seed": True}, {"correction_weight": float("nan")}, {"residual_method": "other"}, {"min_observations": 1.5}):
        with pytest.raises(ValueError):
            ModelSettings(**bad)
    with pytest.raises(ValueError):
        StudyScope(unavailable_years=(1900,))
