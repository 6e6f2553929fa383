"""Time-weighted averaging of irregular interval series.

Each row is an interval known by one stamp (its start or its end).  The other edge is the neighbouring stamp of the same
entity; when that stamp is missing or further away than `max_gap`, the interval is taken to last `nominal`.  An interval
is cut at every bucket edge it crosses and its value is weighted by the seconds it spends in each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.clock import plus_seconds
from wattline.operators.ordered import DAY, with_neighbour
from wattline.settings import MAX_GAP_MINUTES, NOMINAL_MINUTES

FIVE_MINUTES = 300
HOUR = 3600


def reconstruct_intervals(df: DataFrame, entity: list[str], ts: str = "ts_utc", stamped: str = "end",
                          nominal: int = NOMINAL_MINUTES * 60, max_gap: int = MAX_GAP_MINUTES * 60,
                          chunk: int = DAY) -> DataFrame:
    """Add start_ts and end_ts.

    `stamped='end'`: the published stamp was the interval end and the stored `ts` is that stamp minus `nominal`.
    `stamped='start'`: `ts` is the interval start.
    """
    if stamped == "start":
        near = with_neighbour(df, entity, ts, max_gap, forward=True, out="_next", chunk=chunk)
        return (near.withColumn("start_ts", F.col(ts))
                .withColumn("end_ts", F.coalesce(F.col("_next"), plus_seconds(F.col(ts), nominal))).drop("_next"))
    if stamped == "end":
        near = with_neighbour(df, entity, ts, max_gap, forward=False, out="_prev", chunk=chunk)
        return (near.withColumn("end_ts", plus_seconds(F.col(ts), nominal))
                .withColumn("start_ts", F.coalesce(plus_seconds(F.col("_prev"), nominal), F.col(ts))).drop("_prev"))
    raise ValueError(f"stamped must be 'start' or 'end', not {stamped!r}")


def split_over_buckets(df: DataFrame, bucket: int, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """One row per (interval, bucket it touches) with `bucket_ts` and `w` = overlap in seconds (> 0)."""
    width = bucket * 1_000_000
    s, e = F.unix_micros(start), F.unix_micros(end)
    first = s - F.pmod(s, F.lit(width))
    last = e - 1 - F.pmod(e - 1, F.lit(width))
    pieces = df.filter(e > s).withColumn("_b", F.explode(F.sequence(first, last, F.lit(width).cast("long"))))
    overlap = F.least(e, F.col("_b") + width) - F.greatest(s, F.col("_b"))
    return (pieces.withColumn("w", overlap / F.lit(1e6)).withColumn("bucket_ts", F.timestamp_micros("_b"))
            .filter(F.col("w") > 0).drop("_b"))


def time_weighted(df: DataFrame, entity: list[str], values: list[str], bucket: int = FIVE_MINUTES, ts: str = "ts_utc",
                  stamped: str = "end", nominal: int = NOMINAL_MINUTES * 60, max_gap: int = MAX_GAP_MINUTES * 60,
                  chunk: int = DAY) -> DataFrame:
    """Time-weighted mean of `values` per (bucket, entity) and `covered_s`, the seconds of the bucket that had data."""
    slim = df.select(*entity, ts, *values)
    pieces = split_over_buckets(reconstruct_intervals(slim, entity, ts, stamped, nominal, max_gap, chunk), bucket)
    means: list[Column] = [(F.sum(F.col(v) * F.col("w")) / F.sum("w")).alias(v) for v in values]
    out = pieces.groupBy(F.col("bucket_ts"), *entity).agg(*means, F.sum("w").alias("covered_s"))
    return out.withColumnRenamed("bucket_ts", "ts_utc")


def reweight(df: DataFrame, keys: list[str | Column], values: list[str], weight: str = "covered_s") -> DataFrame:
    """Average already time-weighted rows over longer periods: weights are the covered seconds."""
    return df.groupBy(*keys).agg(*[(F.sum(F.col(v) * F.col(weight)) / F.sum(weight)).alias(v) for v in values])


def lookback_filter(ts: Column, start: Column, end: Column, max_gap: int = MAX_GAP_MINUTES * 60) -> Column:
    """Read range for a window query: widened by `max_gap` so the first interval can find its neighbour."""
    return (ts >= plus_seconds(start, -max_gap)) & (ts < end)
