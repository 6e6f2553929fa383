"""Streams over files that arrive: each query runs its stream to the end of the files (availableNow) and is compared with the batch question.

The files are made from the test tables in the session's shared checkpoint folder, in the order in which rows arrive.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.checks.base import BOOK_SQL, SHIFTED_SQL, Tables, check, rounded
from wattline.checks.warehouse import GAP, _twa_sql
from wattline.session import checkpoint_dir
from wattline.streaming import twins

SLOTS, DELAY = 4, 7200                          # files' worth of arrivals; seconds by which a row may be late
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark: SparkSession) -> str:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _arrivals(df: DataFrame, slot, last: DataFrame | None = None) -> DataFrame:
    """A stream that brings the rows of slot 0, 1, ... one batch each, and `last` after them.  One partition a slot, so that a batch is one file."""
    spark, path = df.sparkSession, f"{_folder(df.sparkSession)}/in"
    laid = df.withColumn("_slot", slot).persist()
    for i in range(SLOTS):
        laid.where(F.col("_slot") == i).drop("_slot").coalesce(1).write.mode("append").parquet(path)
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(path)
    laid.unpersist()
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(out: DataFrame) -> DataFrame:
    """The rows that an append stream has written when all files are read."""
    spark = out.sparkSession
    folder = _folder(spark)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _closing(df: DataFrame, ts: str, **values) -> DataFrame:
    """One row far behind all others, of a key of its own: moves the watermark over everything before it."""
    spark = df.sparkSession
    row = [values.get(c, datetime(2030, 1, 1) if c == ts else None) for c in df.columns]
    return spark.createDataFrame([tuple(row)], df.schema)


@check("stream_late_rows", f"WITH {SHIFTED_SQL}, {_twa_sql('5 MINUTE', 'end')} SELECT ts_utc, zone, round(value, 6) AS value, round(covered_s, 6) AS covered_s, CAST(0 AS BIGINT) AS late_rows FROM twa")
def stream_late_rows(t: Tables):
    """events, each delayed by up to `DELAY` seconds by a hash of its id, through the streamed time weighting: the same buckets as in order."""
    s = t.shifted().select("ts_utc", "zone", "value", "event_id")
    arrives = F.unix_timestamp("ts_utc") + F.pmod(F.xxhash64("event_id"), F.lit(DELAY))
    lo, hi = s.agg(F.min(arrives), F.max(arrives)).first()
    stream = _arrivals(s, F.floor((arrives - lo) * SLOTS / (hi - lo + 1)).cast("int"), _closing(s, "ts_utc", zone="~"))
    parts = _run(twins.time_weighted_stream(stream, "zone", "value", max_gap=GAP, lateness=f"{DELAY + 600} seconds"))
    out = twins.finish_partials(parts).where("entity <> '~'").withColumnRenamed("entity", "zone")
    return rounded(out.select("ts_utc", "zone", "value", "covered_s", F.col("late_rows").cast("long").alias("late_rows")))


@check("stream_snapshot_runs", """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS s FROM (SELECT DISTINCT user_id, ts FROM events)),
g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM f), c AS (SELECT user_id, ts, count(*) AS k FROM events GROUP BY 1, 2)
SELECT user_id, min(ts) AS first_seen_utc, max(ts) AS last_seen_utc, CAST(sum(k) AS BIGINT) AS snapshots FROM g JOIN c USING (user_id, ts) GROUP BY user_id, run""")
def stream_snapshot_runs(t: Tables):
    """Validity runs as session windows over delayed events."""
    e = t.events.select("user_id", "ts", "event_id")
    arrives = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(DELAY))
    lo, hi = e.agg(F.min(arrives), F.max(arrives)).first()
    stream = _arrivals(e, F.floor((arrives - lo) * SLOTS / (hi - lo + 1)).cast("int"), _closing(e, "ts", user_id=-1, event_id=-1))
    out = _run(twins.snapshot_sessions(stream, ["user_id"], "ts", lateness=f"{DELAY + 600} seconds"))
    return rounded(out.where("user_id >= 0").select("user_id", "first_seen_utc", "last_seen_utc", "snapshots"))


@check("stream_last_copies", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice
FROM orders GROUP BY 1, 2""")
def stream_last_copies(t: Tables):
    """A customer's orders of a month as copies of one record that come in any order, over batches: the one with the largest key stays."""
    o = t.orders.select(F.trunc("o_orderdate", "MM").alias("month"), "o_custkey", "o_orderkey", "o_totalprice")
    stream = _arrivals(o, F.pmod(F.xxhash64("o_orderkey"), F.lit(SLOTS)).cast("int"))
    folder = _folder(t.spark)
    twins.latest_copies(stream, f"{folder}/table", ["month", "o_custkey"], ["o_orderkey"], "month", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(o.schema).parquet(f"{folder}/table").select("month", "o_custkey", "o_orderkey", "o_totalprice")


@check("stream_daily_upsert", f"WITH {BOOK_SQL} SELECT d, count(*) AS n, round(sum(da), 4) AS da, round(sum(rt), 4) AS rt FROM book GROUP BY 1")
def stream_daily_upsert(t: Tables):
    """Day rows of the book whose zones come in different batches, each first with a wrong value; the stored days are whole and right."""
    b = t.book().select(F.trunc("d", "MM").alias("month"), "d", "zone", "da", "rt")
    both = b.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("da", F.when(F.col("version") == 1, -1.0).otherwise(F.col("da")))
    stream = _arrivals(both, (F.pmod(F.xxhash64("zone"), F.lit(2)) + 2 * (F.col("version") - 1)).cast("int"))
    folder = _folder(t.spark)
    twins.upsert_days(stream, f"{folder}/table", ["d", "zone"], ["version"], "month", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    stored = t.spark.read.schema(both.schema).parquet(f"{folder}/table")
    return rounded(stored.groupBy("d").agg(F.count("*").alias("n"), F.sum("da").alias("da"), F.sum("rt").alias("rt")), 4)
