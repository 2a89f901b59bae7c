"""Calendar expressions: month index, reporting weeks and ISO weeks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def month_index(year: Column, month: Column) -> Column:
    return (year * 12 + month - 1).cast("bigint")


def index_year(m: Column) -> Column:
    return F.floor(m / 12).cast("bigint")


def index_month(m: Column) -> Column:
    return (m % 12 + 1).cast("bigint")


def declared_year(year: Column, years: list[int]) -> Column:
    """The year, or an error where it is not one of those that a table with one column per year has room for."""
    return F.when(year.isin(years), year).otherwise(F.raise_error(F.concat(F.lit("year outside the declared ones: "), F.coalesce(year.cast("string"), F.lit("none")))).cast("bigint"))


def month_label(m: Column) -> Column:
    return F.format_string("%04d-%02d", index_year(m), index_month(m))


def month_name(m: Column) -> Column:
    return F.date_format(month_start(m), "MMMM")


def display_time(utc: Column, hours: int = 8, zone: str = "PHT") -> Column:
    """A UTC time as readers at a fixed offset see it."""
    shifted = F.date_format(utc + F.make_dt_interval(hours=F.lit(hours)), "dd MMM yyyy, hh:mm a")
    return F.coalesce(F.concat(shifted, F.lit(f" {zone}")), F.lit("Not available"))


def month_start(m: Column) -> Column:
    return F.make_date(index_year(m).cast("int"), index_month(m).cast("int"), F.lit(1))


def week_label(year: Column, week: Column) -> Column:
    return F.format_string("%04d-W%02d", year, week)


def first_week_start(year: Column) -> Column:
    """Sunday that opens week 1: the first week with at least four days in the year."""
    january = F.make_date(year.cast("int"), F.lit(1), F.lit(1))
    past_sunday = F.dayofweek(january) - 1
    return F.date_add(january, F.when(past_sunday > 3, 7 - past_sunday).otherwise(-past_sunday))


def week_start(year: Column, week: Column) -> Column:
    return F.date_add(first_week_start(year), (7 * (week - 1)).cast("int"))


def year_length(year: Column) -> Column:
    return (F.datediff(first_week_start(year + 1), first_week_start(year)) / 7).cast("bigint")


def iso_week_one(year: Column) -> Column:
    """Monday of ISO week 1, the week that holds 4 January."""
    return F.date_trunc("week", F.make_date(year.cast("int"), F.lit(1), F.lit(4))).cast("date")


def iso_year_length(year: Column) -> Column:
    return (F.datediff(iso_week_one(year + 1), iso_week_one(year)) / 7).cast("bigint")


def iso_week_month_index(year: Column, week: Column) -> Column:
    """Month of the week's Thursday; week 53 of a 52-week ISO year is December, anything else outside is null."""
    thursday = F.date_add(iso_week_one(year), (7 * (week - 1) + 3).cast("int"))
    inside = week.between(1, iso_year_length(year))
    return F.when(inside, month_index(F.year(thursday), F.month(thursday))).when(
        week == 53, month_index(year, F.lit(12))
    )


def advance_week(year: Column, week: Column, steps: Column, last_known_year: Column) -> tuple[Column, Column]:
    """(year, week) after a number of weeks; null once a year of unknown length would have to be crossed."""
    target = F.date_add(week_start(year, week), (7 * steps).cast("int"))
    landed = F.year(F.date_add(target, 3)).cast("bigint")  # a week belongs to the year of its Wednesday
    known = landed <= last_known_year + 1
    number = (F.datediff(target, first_week_start(landed)) / 7 + 1).cast("bigint")
    return F.when(known, landed), F.when(known, number)
