"""Local/UTC time as column expressions.  The session time zone is UTC, so a TIMESTAMP column is a UTC instant."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattline.settings import ISSUE_HOUR, MARKET_TZ


def to_local(ts: Column, tz: str = MARKET_TZ) -> Column:
    """UTC instant -> local wall clock (TIMESTAMP_NTZ)."""
    return F.from_utc_timestamp(ts, tz).cast("timestamp_ntz")


def local_date(ts: Column, tz: str = MARKET_TZ) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def local_hour(ts: Column, tz: str = MARKET_TZ) -> Column:
    return F.hour(F.from_utc_timestamp(ts, tz))


def local_to_utc(local: Column, tz: str = MARKET_TZ, standard: Column | None = None) -> Column:
    """Local wall clock -> UTC.

    Ambiguous hour: first occurrence, or the second where `standard` is true.  Missing spring hour: shifted forward to
    the first valid instant.
    """
    wall = local.cast("timestamp")
    first = F.to_utc_timestamp(wall, tz)
    later = first + F.expr("INTERVAL 1 HOUR")
    missing = F.from_utc_timestamp(first, tz) != wall
    fixed = F.when(missing, F.date_trunc("hour", first))
    if standard is not None:
        ambiguous = F.from_utc_timestamp(later, tz) == wall
        fixed = fixed.when(ambiguous & standard, later)
    return fixed.otherwise(first)


def local_midnight(day: Column, tz: str = MARKET_TZ) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def local_time_on(day: Column, minutes: int, tz: str = MARKET_TZ) -> Column:
    """UTC instant of `minutes` after local midnight by the wall clock of `day`."""
    wall = day.cast("timestamp") + F.expr(f"INTERVAL {minutes} MINUTE")
    return F.to_utc_timestamp(wall, tz)


def issue_time(day: Column, tz: str = MARKET_TZ, hour: int = ISSUE_HOUR) -> Column:
    """Forecast issue of delivery day `day`: `hour` o'clock local on the day before."""
    return local_time_on(F.date_sub(day, 1), hour * 60, tz)


def day_bounds(day: date, tz: str = MARKET_TZ) -> tuple[Column, Column]:
    """[start, end) of a local day as UTC literals: a filter on the raw column, so it reaches the Parquet scan."""
    zone = ZoneInfo(tz)
    edges = [datetime(d.year, d.month, d.day, tzinfo=zone) for d in (day, day + timedelta(days=1))]
    return tuple(F.lit(e.astimezone(ZoneInfo("UTC"))) for e in edges)  # type: ignore[return-value]


def hours_in_day(day: Column, tz: str = MARKET_TZ) -> Column:
    """23, 24 or 25."""
    micros = F.unix_micros(local_midnight(F.date_add(day, 1), tz)) - F.unix_micros(local_midnight(day, tz))
    return (micros / F.lit(3_600_000_000)).cast("int")


def hours_between_days(first: Column, last: Column, tz: str = MARKET_TZ) -> Column:
    """Exact hours from local midnight of `first` to the end of local day `last`."""
    micros = F.unix_micros(local_midnight(F.date_add(last, 1), tz)) - F.unix_micros(local_midnight(first, tz))
    return (micros / F.lit(3_600_000_000)).cast("long")


def floor_to(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of `seconds` that holds `ts`."""
    width = seconds * 1_000_000
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(width)))


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    step = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(ts) + step.cast("long") * F.lit(1_000_000))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def parse_local(text: Column) -> Column:
    """'MM/dd/yyyy HH:mm[:ss]' -> TIMESTAMP_NTZ, NULL when unparseable."""
    t = F.trim(text)
    return F.coalesce(F.try_to_timestamp(t, F.lit("MM/dd/yyyy HH:mm:ss")),
                      F.try_to_timestamp(t, F.lit("MM/dd/yyyy HH:mm"))).cast("timestamp_ntz")


def round_to_hour(ts: Column) -> Column:
    """Nearest hour; an exact half hour goes to the even hour."""
    hour = 3_600_000_000
    micros = F.unix_micros(ts)
    below = micros - F.pmod(micros, F.lit(hour))
    rest = F.pmod(micros, F.lit(hour))
    up = (rest > hour // 2) | ((rest == hour // 2) & (F.pmod(below / F.lit(hour), F.lit(2)) == 1))
    return F.timestamp_micros(F.when(up, below + hour).otherwise(below))
