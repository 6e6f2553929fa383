"""Range, overlap and validity-interval joins as equi-joins on time buckets (no nested loops)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.clock import issue_time, local_date, local_midnight
from wattline.settings import MARKET_TZ


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str],
                 bucket: int = 86_400) -> DataFrame:
    """Pairs with the same `by` whose half-open spans [start, end) overlap.

    Both sides are spread over the buckets they touch and joined on (by, bucket).  A pair that shares several buckets is
    kept only in the first one, so no distinct is needed.
    """
    def spread(df: DataFrame, span: tuple[str, str], tag: str) -> DataFrame:
        first, last = _bucket(F.col(span[0]), bucket), F.floor((F.unix_micros(span[1]) - 1) / F.lit(bucket * 1_000_000))
        return (df.filter(F.col(span[1]) > F.col(span[0])).withColumn(f"_{tag}0", first)
                .withColumn("_bucket", F.explode(F.sequence(first, last.cast("long")))))

    a, b = spread(left, left_span, "l"), spread(right, right_span, "r")
    joined = a.join(b, [*by, "_bucket"])
    hit = (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(right_span[0]) < F.col(left_span[1]))
    first_shared = F.col("_bucket") == F.greatest("_l0", "_r0")
    return joined.filter(hit & first_shared).drop("_bucket", "_l0", "_r0")


def point_in_span_join(points: DataFrame, spans: DataFrame, by: list[str], ts: str, span: tuple[str, str],
                       bucket: int = 86_400, closed: bool = True) -> DataFrame:
    """Points joined with the spans of the same key that contain them: [start, end] when closed, else [start, end)."""
    first, last = _bucket(F.col(span[0]), bucket), _bucket(F.col(span[1]), bucket)
    wide = spans.filter(F.col(span[1]) >= F.col(span[0])).withColumn("_bucket", F.explode(F.sequence(first, last)))
    pts = points.withColumn("_bucket", _bucket(F.col(ts), bucket))
    upper = F.col(ts) <= F.col(span[1]) if closed else F.col(ts) < F.col(span[1])
    return pts.join(wide, [*by, "_bucket"]).filter((F.col(ts) >= F.col(span[0])) & upper).drop("_bucket")


def explode_days(df: DataFrame, start: str, end: str, out: str = "d", first: Column | None = None, last: Column | None = None,
                 tz: str = MARKET_TZ) -> DataFrame:
    """One row per local day that the half-open span [start, end) overlaps, optionally clipped to [first, last]."""
    lo = local_date(F.col(start), tz)
    hi = local_date(F.timestamp_micros(F.unix_micros(end) - 1), tz)
    lo = F.greatest(lo, first) if first is not None else lo
    hi = F.least(hi, last) if last is not None else hi
    return (df.filter(F.col(end) > F.col(start)).withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi")
            .withColumn(out, F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi"))


def known_and_overlapping(records: DataFrame, days: DataFrame, tz: str = MARKET_TZ, slack_minutes: int = 5) -> DataFrame:
    """Per delivery day d: distinct outages in the schedule as known at issue time whose outage window overlaps d.

    Each record is laid out on the days it overlaps and tested against that day's issue time; days without any keep 0.
    """
    first, last = days.agg(F.min("d"), F.max("d")).first()
    laid = explode_days(records, "sched_out_utc", "sched_in_utc", first=F.lit(first), last=F.lit(last), tz=tz)
    at = issue_time(F.col("d"), tz)
    known = laid.filter((F.col("first_seen_utc") <= at)
                        & (at < F.col("last_seen_utc") + F.expr(f"INTERVAL {slack_minutes} MINUTE")))
    ident = F.concat(F.col("ptid").cast("string"), F.col("equipment"))
    counts = known.groupBy("d").agg(
        F.count_distinct(ident).alias("n_outages"),
        F.count_distinct(F.when(F.col("equipment").contains("345"), ident)).alias("n_outages_345"))
    return days.select("d").distinct().join(counts, "d", "left").na.fill(0, ["n_outages", "n_outages_345"])


def listed_outages(lists: DataFrame, tz: str = MARKET_TZ) -> DataFrame:
    """Outages of the list dated the day before d that are still scheduled to be out on d (no join: d = list day + 1)."""
    laid = lists.withColumn("delivery_date", F.date_add("list_day", 1))
    hit = ((F.col("sched_in_utc") > local_midnight(F.col("delivery_date"), tz))
           & (F.col("sched_out_utc") < local_midnight(F.date_add("delivery_date", 1), tz)))
    return laid.filter(hit).groupBy("delivery_date").agg(
        F.count_distinct("equipment").alias("dam_outages"),
        F.count_distinct(F.when(F.col("equipment").contains("345"), F.col("equipment"))).alias("dam_outages_345"))


def hour_starts(day: Column, tz: str = MARKET_TZ) -> Column:
    """array<timestamp> of the 24 wall-clock hours of a local day in UTC (first occurrence; missing hour shifted)."""
    from wattline.functions.clock import local_to_utc

    return F.transform(F.sequence(F.lit(0), F.lit(23)),
                       lambda h: local_to_utc(day.cast("timestamp") + F.make_dt_interval(F.lit(0), h), tz))


def expected_out(lists: DataFrame, tz: str = MARKET_TZ) -> DataFrame:
    """(d, hr, equipment): on the list of d-1 and scheduled to be out during wall-clock hour hr of d."""
    laid = lists.withColumn("d", F.date_add("list_day", 1))
    laid = laid.select("d", "equipment", "sched_out_utc", "sched_in_utc", F.posexplode(hour_starts(F.col("d"), tz)).alias("hr", "h0"))
    hit = (F.col("sched_out_utc") < F.col("h0") + F.expr("INTERVAL 1 HOUR")) & (F.col("sched_in_utc") > F.col("h0"))
    return laid.filter(hit).select("d", "hr", "equipment").distinct()


def window_stats(facts: DataFrame, anchors: DataFrame, by: list[str], ts: str, anchor: str, value: str, alt: str,
                 short_hours: int = 24, long_days: int = 7, delay_minutes: int = 20, threshold: float = 50.0) -> DataFrame:
    """Conditional statistics over the `long_days` before each anchor, counting only facts published by then.

    Anchors are spread over the UTC days of their look-back, so the join is on (by, day); sums, maxima and counts combine
    on the map side before the final shuffle.
    """
    at = F.col(anchor)
    lo = at - F.expr(f"INTERVAL {long_days} DAY")
    spread = (anchors.select(*by, anchor).distinct()
              .withColumn("_day", F.explode(F.sequence(F.to_date(lo), F.to_date(at)))))
    joined = facts.withColumn("_day", F.to_date(ts)).join(spread, [*by, "_day"]).filter(
        (F.col(ts) >= lo) & (F.col(ts) + F.expr(f"INTERVAL {delay_minutes} MINUTE") <= at))
    recent = F.when(F.col(ts) >= at - F.expr(f"INTERVAL {short_hours} HOUR"), F.col(value))
    short = (F.col(value) > threshold) | (F.col(alt) > threshold)
    return joined.groupBy(*by, anchor).agg(
        F.max(recent).alias("recent_max"), F.avg(recent).alias("recent_mean"), F.count(F.when(short, 1)).alias("shortage"),
        (F.max(ts) + F.expr(f"INTERVAL {delay_minutes} MINUTE")).alias("avail"))
