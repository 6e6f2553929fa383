"""Coverage audit, duplicate keys, table statistics, schema drift and content checksums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.clock import floor_to, hours_in_day, local_date, plus_seconds
from wattline.settings import MARKET_TZ


def daily_presence(df: DataFrame, entity: list[str], interval_min: int, ts: str = "ts_utc", tz: str = MARKET_TZ) -> DataFrame:
    """Per local day: distinct snapped intervals, distinct entities, rows."""
    snapped = floor_to(plus_seconds(F.col(ts), interval_min * 30), interval_min * 60)
    return df.select(local_date(F.col(ts), tz).alias("day"), snapped.alias("_t"), F.concat_ws("|", *entity).alias("_e")).groupBy(
        "day").agg(F.count_distinct("_t").alias("intervals"), F.count_distinct("_e").alias("entities"),
                   F.count(F.lit(1)).alias("rows"))


def coverage(df: DataFrame, entity: list[str], interval_min: int, ts: str = "ts_utc", sparse: bool = False,
             tz: str = MARKET_TZ) -> DataFrame:
    """Daily coverage = intervals seen / intervals expected (23, 24 or 25 hours), at most 1; absent days count as 0.

    Sparse event tables only report presence.
    """
    seen = daily_presence(df, entity, interval_min, ts, tz)
    if not sparse:
        days = seen.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
        seen = days.join(seen, "day", "left").na.fill(0, ["intervals", "entities", "rows"])
    expected = F.greatest(F.floor(hours_in_day(F.col("day"), tz) * F.lit(60) / F.lit(interval_min)), F.lit(1)).cast("long")
    share = F.lit(1.0) if sparse else F.least(F.col("intervals") / F.col("expected"), F.lit(1.0))
    return seen.withColumn("expected", expected).withColumn("coverage", share)


def coverage_summary(cov: DataFrame, by: list[str], threshold: float = 0.99) -> DataFrame:
    return cov.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.avg("coverage").alias("coverage"),
                                F.count_if(F.col("coverage") < threshold).alias("bad_days"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of keys that occur more than once (one row)."""
    return df.groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate_keys"))


def table_stats(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count and time span per table, one partial aggregate each."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.min(t).cast("string").alias("first"), F.max(t).cast("string").alias("last"))
             .select(F.lit(name).alias("table_name"), "rows", "first", "last") for name, (df, t) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def column_checksums(df: DataFrame, keys: list[str]) -> DataFrame:
    """(column, checksum, rows): order-free content hash per column, in one pass over the table.

    Every value is hashed together with its row key, so moving a value to another row changes the sum.
    """
    def total(c: str) -> Column:
        return F.sum(F.xxhash64(*keys, F.lit(c), F.col(c)).cast("decimal(38,0)"))

    sums = df.agg(F.count(F.lit(1)).alias("_rows"), *[total(c).alias(c) for c in df.columns])
    return sums.unpivot(["_rows"], df.columns, "column", "checksum").select(
        "column", F.col("checksum").cast("string").alias("checksum"), F.col("_rows").alias("rows"))


def content_hash(checksums: DataFrame) -> DataFrame:
    """One hash over the sorted (column, checksum) pairs."""
    pairs = F.sort_array(F.collect_list(F.concat_ws("=", "column", "checksum")))
    return checksums.agg(F.sha2(F.concat_ws(";", pairs), 256).alias("content_hash"), F.max("rows").alias("rows"))


def checksum_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns added, removed or changed between two checksum tables."""
    j = a.select("column", F.col("checksum").alias("_a")).join(b.select("column", F.col("checksum").alias("_b")), "column", "full")
    change = (F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
              .when(F.col("_a") != F.col("_b"), "changed"))
    return j.withColumn("change", change).filter("change IS NOT NULL").select("column", "change")


def schema_drift(df: DataFrame, declared: dict[str, str], descriptions: dict[str, str] | None = None) -> DataFrame:
    """Problems of a table against its declaration: missing, undeclared, wrong type, undescribed."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    problems = [(c, "missing") for c in declared if c not in actual]
    problems += [(c, "undeclared") for c in actual if c not in declared]
    problems += [(c, f"type {actual[c]} instead of {t}") for c, t in declared.items() if c in actual and actual[c] != t]
    if descriptions is not None:
        problems += [(c, "undescribed") for c in declared if not descriptions.get(c)]
    return df.sparkSession.createDataFrame(problems, "column string, problem string")
