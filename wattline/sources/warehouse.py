"""Parquet layout of the warehouse: month partitions, incremental backfill, views, column-tolerant reads."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wattline.settings import MARKET_TZ

SORT_COLUMNS = ("ts_utc", "ptid", "zone", "fuel", "facility", "interface")
PUBLISH_LAG_DAYS = 2


def write_months(df: DataFrame, path: str, month: Column, sort: tuple[str, ...] = SORT_COLUMNS, files_per_month: int = 1,
                 mode: str = "overwrite") -> None:
    """Parquet under year=/month=, sorted by time then entity inside each file.

    Only the partitions present in `df` are replaced.  `files_per_month` spreads a large month over that many tasks and
    files by a hash of its rows' sort key.
    """
    order = [c for c in sort if c in df.columns]
    parts = df.withColumn("year", F.year(month)).withColumn("month", F.month(month))
    salt = F.pmod(F.xxhash64(*order), F.lit(files_per_month)) if files_per_month > 1 else F.lit(0)
    spread = parts.withColumn("_salt", salt).repartition("year", "month", "_salt").drop("_salt")
    (spread.sortWithinPartitions("year", "month", *order).write.mode(mode).partitionBy("year", "month")
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(path))


def write_by_source_month(df: DataFrame, path: str, source_date: str, **kw) -> None:
    """Partition by the month of the source file (a shifted interval may belong to the neighbouring month)."""
    write_months(df, path, F.col(source_date), **kw)


def write_by_local_month(df: DataFrame, path: str, time_col: str, tz: str = MARKET_TZ, **kw) -> None:
    is_date = dict(df.dtypes)[time_col] == "date"
    month = F.col(time_col) if is_date else F.from_utc_timestamp(F.col(time_col), tz)
    write_months(df, path, month, sort=tuple(dict.fromkeys([time_col, *SORT_COLUMNS])), **kw)


def wanted_months(spark: SparkSession, keys: list[str], first: date, last: date) -> DataFrame:
    """(key, month) for every month of the range."""
    months = spark.range(1).select(F.explode(F.sequence(F.lit(first.replace(day=1)), F.lit(last.replace(day=1)),
                                                        F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return months.select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"), "month")


def incomplete(month: Column, written: Column, today: Column) -> Column:
    """A stored month may lack days: it is the current one, or was written before its last day could be published."""
    return (F.trunc(today, "MM") == month) | (written < F.date_add(F.last_day(month), PUBLISH_LAG_DAYS))


def backfill_plan(wanted: DataFrame, manifest: DataFrame, today: date) -> DataFrame:
    """(key, month) still to be loaded: absent from the manifest (key, month, written_at), or incomplete in it."""
    done = manifest.groupBy("key", "month").agg(F.max("written_at").alias("written_at"))
    good = done.filter(~incomplete(F.col("month"), F.to_date("written_at"), F.lit(today)))
    return wanted.join(good, ["key", "month"], "left_anti")


def month_days(month: date, today: date) -> Column:
    """Days of a month that are not in the future."""
    m = F.lit(month)
    return F.sequence(m, F.least(F.last_day(m), F.lit(today)))


def read_table(spark: SparkSession, path: str, start: date | None = None, end: date | None = None, ts: str = "ts_utc",
               keep_partitions: bool = False) -> DataFrame:
    """Curated table; a time range also prunes month partitions (one month of slack for stamps shifted across an edge)."""
    df = spark.read.parquet(path)
    if {"year", "month"} <= set(df.columns):
        index = F.col("year") * 12 + F.col("month")
        if start is not None:
            df = df.filter(index >= start.year * 12 + start.month - 1)
        if end is not None:
            df = df.filter(index <= end.year * 12 + end.month + 1)
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(ts) < F.lit(end).cast("timestamp"))
    return df if keep_partitions else df.drop("year", "month")


def register_views(spark: SparkSession, root: str, tables: list[str]) -> list[str]:
    """One temporary view per table that exists under `root`; returns the names."""
    made = []
    for name in tables:
        try:
            df = spark.read.parquet(f"{root}/{name}")
        except AnalysisException:
            continue
        df.drop("year", "month").createOrReplaceTempView(name)
        made.append(name)
    return made


def select_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist: pruned at the Parquet scan."""
    return df.select(*[c for c in wanted if c in df.columns])


def union_runs(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
