"""Rules that only show on holes, odd keys, later years, folders and bad settings."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyspan.config import ModelSettings
from tallyspan.functions import calendar as cal
from tallyspan.operators import forecast, lags
from tallyspan.operators.intake import canonical_names
from tallyspan.plans.forecasts import fold_rows
from tallyspan.session import new_folder
from tallyspan.sources import series
from tallyspan.streaming import intake


def monthly(spark, rows):
    return spark.createDataFrame(rows, "k string, m bigint, y bigint")


def test_a_hole_leaves_the_trend_beside_it_unknown(spark):
    full = [("a", m, 10 * m + m % 12) for m in range(60)]
    whole = {r["m"]: r["trend"] for r in lags.decompose(monthly(spark, full)).collect()}
    holed = {r["m"]: r["trend"] for r in lags.decompose(monthly(spark, [r for r in full if r[1] != 30])).collect()}
    assert all(holed[m] is None for m in holed if abs(m - 30) <= 6) and [m for m in whole if whole[m] is None] == [*range(6), *range(54, 60)]
    assert all(holed[m] == whole[m] for m in holed if abs(m - 30) > 6)


def test_splits_count_calendar_positions(spark):
    df = monthly(spark, [("a", m, m) for m in range(60) if m not in (50, 40)])
    parts = {r["m"]: r["split"] for r in forecast.three_way_split(df, 12, 12).collect()}
    assert {m for m in parts if parts[m] == "test"} == set(range(48, 60)) - {50} and {m for m in parts if parts[m] == "validation"} == set(range(36, 48)) - {40}
    last = {r["m"]: r["train"] for r in forecast.rolling_folds(df, 2, 12).filter("fold = 3").collect()}
    assert {m for m in last if not last[m]} == set(range(48, 60)) - {50}
    window = {r["m"] for r in forecast.window_variants(df, [24], [12], 12).collect()}
    assert window == set(range(12, 48)) - {40}


def test_folds_keep_keys_with_any_character(spark):
    rows = fold_rows(monthly(spark, [(f"Brand#{i}", m, m + i) for i in range(3) for m in range(72)])).collect()
    assert {r["k"] for r in rows} == {"Brand#0", "Brand#1", "Brand#2"} and {r["fold"] for r in rows} == {1, 2, 3, 4}
    assert len({(r["k"], r["fold"], r["m"], r["model"]) for r in rows}) == len(rows) == 3 * 4 * 12 * 2


def test_every_month_from_the_last_reported_year_is_scored(spark):
    rows = [("a", m, 1) for m in range(36, 60)] + [("a", 61, None), ("b", 36, 2), ("b", 50, 3)]
    frame = {(r["k"], r["m"]): (r["train"], r["h"]) for r in forecast.backtest_frame(monthly(spark, rows)).collect()}
    assert len(frame) == len(rows) and frame["a", 47] == (True, None) and frame["a", 48] == (False, 1) and frame["a", 61] == (False, 14) and frame["b", 50] == (False, 3)


def test_weeks_advance_over_many_years(spark):
    start = datetime.date(2000, 1, 2)
    df = spark.createDataFrame([(2000, 1, n) for n in range(0, 600, 7)], "y long, w long, n long")
    year, week = cal.advance_week(F.col("y"), F.col("w"), F.col("n"), F.lit(2020))
    for row in df.select("n", year.alias("year"), week.alias("week")).collect():
        day = start + datetime.timedelta(7 * row["n"])
        assert row["year"] == (day + datetime.timedelta(3)).year and 1 <= row["week"] <= 53
        opened = datetime.date(row["year"], 1, 4) - datetime.timedelta((datetime.date(row["year"], 1, 4).weekday() + 1) % 7)
        assert day == opened + datetime.timedelta(7 * (row["week"] - 1))


def test_streams_read_folders_of_files_out_of_order(spark):
    root = new_folder(spark, "stream-test")
    schema = "id long, ts timestamp"
    parts = [[(5, "2020-01-05"), (6, "2020-01-06")], [(1, "2020-01-01"), (2, "2020-01-02")], [(3, "2020-01-03"), (5, "2020-01-05")]]
    for part in parts:
        rows = spark.createDataFrame(part, "id long, ts string").withColumn("ts", F.to_timestamp("ts"))
        rows.coalesce(1).write.mode("append").parquet(f"{root}/events.parquet")
    stored = intake.drain(intake.read_stream(spark, f"{root}/events.parquet", spark.read.parquet(f"{root}/events.parquet").schema), "out")
    assert sorted(r["id"] for r in stored.collect()) == [1, 2, 3, 5, 5, 6] and schema


def test_fact_tables_are_shuffled_once_by_key(spark):
    plan = series.brand_monthly(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum") == 1 and plan.index("partial_sum") < plan.index("Join")


def test_settings_report_all_problems_at_once():
    with pytest.raises(ValueError, match="lags.*correction_clip.*gap_handling"):
        ModelSettings(lags=0, correction_clip=float("nan"), gap_handling="fill")
    with pytest.raises(ValueError):
        ModelSettings(seed=True)
    assert ModelSettings().signature == ModelSettings().signature != ModelSettings(seed=1).signature


def test_canonical_names():
    assert canonical_names(["A b", "c"], {"a_b": "x", "c": "x"}) == ["x", "c"] and canonical_names(["a", "x"], {"a": "x"}) == ["a", "x"]
