import uuid
from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from wattline.operators.runs import compact_snapshots
from wattline.operators.timeweight import time_weighted
from wattline.plans.postprocess import ConformalState
from wattline.settings import QCOLS
from wattline.streaming import twins

T0 = datetime(2024, 1, 1)


def drop_files(df, path, order, n):
    """Write the rows in time order as n files, the way files arrive."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // n)
    for i in range(n):
        df.sparkSession.createDataFrame(rows[i * step:(i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, df, tmp_path, order, n=3):
    path = str(tmp_path / "in")
    drop_files(df, path, order, n)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(out, mode="append"):
    name = "t" + uuid.uuid4().hex[:8]
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return out.sparkSession.table(name)


def series(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for e in ("a", "b"):
        t = T0
        for _ in range(n):
            t += timedelta(seconds=int(rng.choice([150, 300, 300, 420, 2000])))
            rows.append((t, e, float(rng.normal(30, 5))))
    return spark.createDataFrame(rows, "t timestamp_ntz, e string, v double").select(F.col("t").cast("timestamp").alias("ts_utc"), "e", "v")


def test_last_copy_wins_over_batches(spark, tmp_path):
    """A corrected copy in a later batch, an outdated one after it, and a day that arrives in two batches."""
    rows = [("a", date(2024, 1, 1), 1, 1.0), ("b", date(2024, 1, 1), 1, 2.0), ("a", date(2024, 1, 1), 3, 9.0), ("c", date(2024, 1, 2), 1, 5.0), ("a", date(2024, 1, 1), 2, 7.0), ("d", date(2024, 1, 1), 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, day date, version int, v double")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(0, 6, 2):
        spark.createDataFrame(rows[i:i + 2], df.schema).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):                                        # the second run starts from its own checkpoint and replays everything
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = twins.latest_copies(stream, out, ["k", "day"], ["version"], "day", str(tmp_path / f"cp{uuid.uuid4().hex[:6]}")).start()
        q.processAllAvailable()
        q.stop()
        assert {(r["k"], r["v"]) for r in spark.read.parquet(out).collect()} == {("a", 9.0), ("b", 2.0), ("c", 5.0), ("d", 4.0)}


def arriving(spark, tmp_path, slots, schema):
    """A stream of the given files, one a batch; a far row of entity `end` comes last and closes all others."""
    src = str(tmp_path / "in")
    for rows in [*slots, [(T0 + timedelta(days=400), "end", 0.0)]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(src)


SERIES = "ts_utc timestamp, e string, v double"


def test_rows_out_of_order_have_their_weight(spark, tmp_path):
    """The row of minute 7 comes a batch after that of minute 10; within the lateness it counts as if it had come in order."""
    at = lambda *rows: [(T0 + timedelta(minutes=m), "a", v) for m, v in rows]                     # noqa: E731
    stream = arriving(spark, tmp_path, [at((5, 1.0), (10, 2.0)), at((7, 50.0)), at((15, 3.0))], SERIES)
    parts = drain(twins.time_weighted_stream(stream, "e", "v", nominal=0, lateness="10 minutes"))
    got = {r["ts_utc"].minute: (r["value"], r["covered_s"]) for r in twins.finish_partials(parts).where("entity = 'a'").collect()}
    assert got == {5: ((50.0 * 2 + 2.0 * 3) / 5, 300.0), 10: (3.0, 300.0)}


def test_shuffled_arrival_equals_batch(spark, tmp_path):
    """Rows delayed by up to an hour, over chunks of two hours, from several series; one of them has most of the rows."""
    rng = np.random.default_rng(11)
    rows = []
    for e, n in (("a", 300), ("b", 40), ("c", 3)):
        t = T0
        for _ in range(n):
            t += timedelta(seconds=int(rng.choice([150, 300, 300, 420, 2000])), microseconds=int(rng.integers(0, 10**6)))
            rows.append((t, e, float(rng.normal(30, 5))))
    arrival = [t + timedelta(seconds=float(rng.uniform(0, 3500))) for t, *_ in rows]
    order = np.argsort(arrival)
    slots = [[rows[i] for i in part] for part in np.array_split(order, 5)]
    df = spark.createDataFrame(rows, SERIES)
    batch = time_weighted(df, ["e"], ["v"]).select("ts_utc", F.col("e").alias("entity"), F.round("v", 6).alias("value"), F.round("covered_s", 3).alias("covered_s"))
    parts = drain(twins.time_weighted_stream(arriving(spark, tmp_path, slots, SERIES), "e", "v", chunk=7200))
    done = twins.finish_partials(parts).where("entity <> 'end'")
    got = done.select("ts_utc", "entity", F.round("value", 6).alias("value"), F.round("covered_s", 3).alias("covered_s"))
    assert got.count() == batch.count() and got.exceptAll(batch).count() == 0 and done.agg(F.sum("late_rows")).first()[0] == 0


def test_rows_beyond_the_lateness_have_no_weight(spark, tmp_path):
    at = lambda *rows: [(T0 + timedelta(minutes=m), "a", v) for m, v in rows]                     # noqa: E731
    stream = arriving(spark, tmp_path, [at((5, 1.0), (10, 2.0)), at((90, 4.0)), at((91, 4.0)), at((7, 50.0))], SERIES)
    parts = drain(twins.time_weighted_stream(stream, "e", "v", nominal=0, lateness="5 minutes"))
    got = {r["ts_utc"].minute: r["value"] for r in twins.finish_partials(parts).where("entity = 'a' and covered_s > 0").collect()}
    assert got[5] == 2.0


def test_sessions_match_compaction(spark, tmp_path):
    df = series(spark, 40, 1)
    batch = compact_snapshots(df, ["e"], "ts_utc", 900)
    got = drain(twins.snapshot_sessions(stream_of(spark, df, tmp_path, "ts_utc"), ["e"], lateness="0 seconds"))
    # a session is emitted once the watermark has passed its end, so the open one of the last file stays out
    assert got.count() >= batch.count() - 4 and got.join(batch, got.columns, "left_anti").count() == 0


def test_conformal_matches_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"s{k}", i, float(rng.normal(40, 3)), float(rng.normal(40, 5))) for i in range(80) for k in range(2)]
    df = spark.createDataFrame(rows, "series string, day int, mean double, y double")
    got = drain(twins.conformal_stream(stream_of(spark, df, tmp_path, "day", 4), window_days=50, min_obs=10)).filter("series = 's1'").orderBy("day").toPandas()
    s = ConformalState(50, 0.01, 10, 2)
    want = [s.step(d, m, y) for k, d, m, y in rows if k == "s1"]
    want = np.array([np.full(21, np.nan) if w is None else w for w in want])
    assert np.allclose(got[QCOLS].to_numpy(float), want, equal_nan=True)
