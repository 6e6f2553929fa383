"""The library's scalar rules and grid as functions that `spark.sql` knows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from wattline.settings import MARKET_TZ


@udtf(returnType="ts_utc timestamp, ts_local timestamp_ntz, hour_of_day int")
class _DayGrid:
    """All steps of a local day: 23, 24 or 25 hours' worth."""

    def eval(self, day: date, minutes: int) -> Iterator[tuple]:
        zone, utc = ZoneInfo(MARKET_TZ), ZoneInfo("UTC")
        if day is None or minutes is None or minutes <= 0:
            return
        at, end = (datetime(d.year, d.month, d.day, tzinfo=zone).astimezone(utc) for d in (day, day + timedelta(days=1)))
        first = at
        while at < end:
            yield at, at.astimezone(zone).replace(tzinfo=None), int((at - first).total_seconds() // 3600)
            at += timedelta(minutes=minutes)


def register_functions(spark: SparkSession, tz: str = MARKET_TZ) -> SparkSession:
    """Temporary functions of the session, inlined by the optimizer: to_local(ts), the market's wall clock, and weighted_mean(total, weight), the second step of a
    time-weighted mean: weighted_mean(sum(v * w), sum(w)), NULL without weight (a SQL function may not hold the aggregates itself, and left to Spark they
    combine before the shuffle).  day_grid(day, minutes) is a table function for LATERAL joins."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION to_local(ts TIMESTAMP) RETURNS TIMESTAMP_NTZ RETURN CAST(from_utc_timestamp(ts, '{tz}') AS TIMESTAMP_NTZ)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION weighted_mean(total DOUBLE, weight DOUBLE) RETURNS DOUBLE RETURN try_divide(total, weight)")
    spark.udtf.register("day_grid", _DayGrid)
    return spark
