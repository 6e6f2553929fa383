"""Holiday calendar and calendar features."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: off-peak holidays.  (name, month, day) for fixed dates; (name, month, ISO weekday, nth) otherwise,
# nth = -1 being the last one of the month.
FIXED_HOLIDAYS = [("New Year's Day", 1, 1), ("Independence Day", 7, 4), ("Christmas Day", 12, 25)]
FLOATING_HOLIDAYS = [("Memorial Day", 5, 1, -1), ("Labor Day", 9, 1, 1), ("Thanksgiving Day", 11, 4, 4)]


def holidays_of(year: int) -> list[tuple[date, str]]:
    """Off-peak holidays of a year; one that falls on a Sunday is kept on the Monday."""
    found = []
    for name, month, day in FIXED_HOLIDAYS:
        d = date(year, month, day)
        found.append((d + timedelta(days=1) if d.isoweekday() == 7 else d, name))
    for name, month, weekday, nth in FLOATING_HOLIDAYS:
        month_days = [date(year, month, 1) + timedelta(days=i) for i in range(31)]
        matches = [d for d in month_days if d.month == month and d.isoweekday() == weekday]
        found.append((matches[nth] if nth < 0 else matches[nth - 1], name))
    return sorted(found)


def holiday_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(d, name): six rows a year, small enough to broadcast whatever the size of the facts."""
    rows = [r for y in range(first_year, last_year + 1) for r in holidays_of(y)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("d", T.DateType()), T.StructField("name", T.StringType())]))


def is_holiday(day: Column, first_year: int = 2014, last_year: int = 2035) -> Column:
    """Membership test against the generated dates: a literal set, so no join is planned."""
    return day.isin([d for y in range(first_year, last_year + 1) for d, _ in holidays_of(y)])


def iso_weekday(day: Column) -> Column:
    return F.weekday(day) + 1


def peak_period(local_ts: Column, holiday: Column) -> Column:
    """'peak' for Monday-Friday hours 7 to 22 outside holidays, else 'offpeak'."""
    on = (F.weekday(local_ts) < 5) & F.hour(local_ts).between(7, 22) & ~holiday
    return F.when(on, "peak").otherwise("offpeak")


def calendar_columns(day: Column) -> dict[str, Column]:
    angle = F.lit(2) * F.pi() * F.dayofyear(day) / F.lit(365.25)
    return {"dow": iso_weekday(day), "month": F.month(day), "is_weekend": iso_weekday(day) >= 6,
            "is_holiday": is_holiday(day), "doy_sin": F.sin(angle), "doy_cos": F.cos(angle)}
