"""Gap-based grouping: snapshot compaction into validity runs, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.ordered import DAY, running_sum, with_neighbour


def number_runs(df: DataFrame, keys: list[str], ts: str, gap: int, out: str = "run", chunk: int = DAY) -> DataFrame:
    """Number the runs of each key: a row more than `gap` seconds after the row before it starts a new run."""
    near = with_neighbour(df, keys, ts, gap, out="_prev", chunk=chunk)
    start = F.col("_prev").isNull().cast("long")
    return running_sum(near, keys, ts, start, out, chunk=chunk).drop("_prev")


def compact_snapshots(df: DataFrame, keys: list[str], ts: str = "ts_utc", gap: int = 900, chunk: int = DAY) -> DataFrame:
    """Repeated snapshots of a record -> one row per contiguous run with its first and last sighting.

    Copies of one (record, stamp) are counted but give one neighbour test, so a hot group of copies collapses before
    the ordered step.
    """
    stamps = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_copies"))
    runs = number_runs(stamps, keys, ts, gap, out="_run", chunk=chunk)
    return runs.groupBy(*keys, "_run").agg(
        F.min(ts).alias("first_seen_utc"), F.max(ts).alias("last_seen_utc"), F.sum("_copies").alias("snapshots")).drop("_run")
