"""Structured Streaming twins of the batch operators.  Each is checked against its batch counterpart in the tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wattline.operators.ordered import DAY, keep_last
from wattline.operators.timeweight import split_over_buckets
from wattline.plans.postprocess import ConformalState
from wattline.session import cut_lineage
from wattline.settings import MAX_GAP_MINUTES, NOMINAL_MINUTES, QCOLS


def latest_copies(stream: DataFrame, path: str, keys: list[str], order: list[str], day: str, checkpoint: str):
    """File-drop ingestion: a table with the last copy of each key by `order`, as the batch rule has it, whatever batch a copy comes in.

    A micro-batch is merged with the stored rows of the days it touches and those partitions are rewritten, so a corrected or late copy and a day that
    arrives in parts are all right, and replaying a batch changes nothing.  The merged rows are checkpointed before the old ones are replaced.
    """
    def write(batch: DataFrame, _epoch: int) -> None:
        rows, spark = batch, batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            stored = spark.read.schema(batch.schema).parquet(path)
            rows = stored.join(batch.select(day).distinct(), day, "left_semi").select(batch.columns).unionByName(batch)
        merged = cut_lineage(keep_last(rows, keys, order))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def snapshot_sessions(stream: DataFrame, keys: list[str], ts: str = "ts_utc", gap: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """Validity runs as session windows: a gap above `gap` closes the run."""
    s = stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), *keys)
    return s.agg(F.min(ts).alias("first_seen_utc"), F.max(ts).alias("last_seen_utc"), F.count(F.lit(1)).alias("snapshots")).drop("session_window")


class _HeldRows(StatefulProcessor):
    """Holds the rows of one (entity, chunk of time) until the watermark has passed them and gives out their intervals in order of their stamps.

    Rows that arrive out of order, in one batch or over many, wait in list state; an event-time timer on the earliest of them wakes the key.  Only the
    last stamp given out is kept beside them, and all state goes when the watermark has passed the chunk.  Rows marked `halo` belong to the chunk before
    and only serve as the neighbour of the chunk's first rows.  A row behind the last stamp given out came later than the stream's lateness and is counted.
    """

    def __init__(self, nominal: int, max_gap: int, chunk: int):
        self.nominal, self.max_gap, self.chunk = nominal, max_gap, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "stamp long, value double, halo boolean")
        self.last = handle.getValueState("last", "stamp long")

    def _end(self, key) -> int:
        return (int(key[1]) + 1) * self.chunk * 1000

    def _wake(self, stamp: int) -> None:
        self.handle.registerTimer(-(-stamp // 1000))           # timers are in milliseconds, stamps in microseconds

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get()[0] if self.last.exists() else None
        earliest = None
        for pdf in rows:
            late = pdf["stamp"].to_numpy(np.int64) <= (known if known is not None else np.iinfo(np.int64).min)
            if late.any():
                own = pdf[late & ~pdf["halo"].to_numpy(bool)]
                if len(own):
                    yield pd.DataFrame({"entity": key[0], "value": 0.0, "start_us": own["stamp"] - 1_000_000, "end_us": own["stamp"], "late": 1})
                pdf = pdf[~late]
            if len(pdf):
                self.held.appendList(list(pdf[["stamp", "value", "halo"]].itertuples(index=False, name=None)))
                first = int(pdf["stamp"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(earliest)
            self.handle.registerTimer(self._end(key))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.held.get()) if self.held.exists() else []
        ready = [r for r in rows if r[0] <= passed]
        rest = rows[len(ready):]
        if ready:
            known = self.last.get()[0] if self.last.exists() else np.iinfo(np.int64).min // 2
            stamp, value, halo = (np.array(c) for c in zip(*ready, strict=True))
            prev = np.concatenate([[known], stamp[:-1]])
            start = np.where(stamp - prev > self.max_gap * 1_000_000, stamp - self.nominal * 1_000_000, prev)
            self.last.update((int(stamp[-1]),))
            own = ~halo.astype(bool)
            if own.any():
                yield pd.DataFrame({"entity": key[0], "value": value[own].astype(float), "start_us": start[own], "end_us": stamp[own], "late": 0})
            if rest:
                self.held.put(rest)
            else:
                self.held.clear()
        if rest:
            self._wake(rest[0][0])
        elif passed >= self._end(key) * 1000:
            self.last.clear()

    def close(self) -> None:
        pass


def time_weighted_stream(stream: DataFrame, entity: str, value: str, bucket: int = 300, ts: str = "ts_utc", nominal: int = NOMINAL_MINUTES * 60,
                         max_gap: int = MAX_GAP_MINUTES * 60, lateness: str = "1 hour", chunk: int = DAY) -> DataFrame:
    """Time-weighted buckets of an end-stamped stream whose rows may arrive in any order within `lateness`: the sums are those of the batch operator.

    An entity's rows are keyed by chunks of `chunk` seconds, each with a halo of `max_gap` from the chunk before, so a series that holds a third of all rows
    is spread over tasks and state ends with its chunk.  Output (append mode): one partial sum for each interval and bucket, once the watermark has passed the interval's
    end; `finish_partials` adds partials up.  Rows later than `lateness` have no weight: Spark drops those behind the watermark (its metric counts
    them), and one that comes between the watermark and the last stamp given out is counted in `late` of its bucket.  Rows of the last `lateness` of
    a stream stay held until later rows move the watermark.
    """
    if max_gap > chunk:
        raise ValueError("max_gap must fit inside one chunk")
    width = chunk * 1_000_000
    rows = stream.withColumn("_stamp_ts", F.col(ts) + F.make_dt_interval(secs=F.lit(nominal))).withWatermark("_stamp_ts", lateness)
    stamp = F.unix_micros("_stamp_ts")
    home = F.floor(stamp / F.lit(width)).cast("long")
    both = F.when(F.pmod(stamp, F.lit(width)) >= F.lit(width - max_gap * 1_000_000), F.array(home, home + 1)).otherwise(F.array(home))
    laid = rows.select("_stamp_ts", F.col(entity).alias("entity"), stamp.alias("stamp"), F.col(value).cast("double").alias("value"), home.alias("home"), F.explode(both).alias("chunk"))
    keyed = laid.select("_stamp_ts", "entity", "chunk", "stamp", "value", (F.col("chunk") != F.col("home")).alias("halo"))
    out = keyed.groupBy("entity", "chunk").transformWithStateInPandas(
        _HeldRows(nominal, max_gap, chunk), "entity string, value double, start_us long, end_us long, late int", outputMode="Append", timeMode="EventTime")
    spans = out.select("entity", "value", "late", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros("end_us").alias("end_ts"))
    pieces = split_over_buckets(spans, bucket)
    return pieces.select("bucket_ts", "entity", F.when(F.col("late") == 0, F.col("value") * F.col("w")).otherwise(0.0).alias("vw"), F.when(F.col("late") == 0, F.col("w")).otherwise(F.lit(0).cast("double")).alias("w"), "late")


def finish_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy(F.col("bucket_ts").alias("ts_utc"), "entity").agg(F.try_divide(F.sum("vw"), F.sum("w")).alias("value"), F.sum("w").alias("covered_s"), F.sum("late").alias("late_rows"))


class _Conformal(StatefulProcessor):
    """Online conformal calibration with the batch kernel; the state is kept as one record per series."""

    def __init__(self, **options):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "alpha array<double>, days array<int>, resid array<double>, due array<int>, at array<int>, lo array<double>, hi array<double>")

    def _load(self) -> ConformalState:
        s = ConformalState(**self.options)
        if self.state.exists():
            alpha, days, resid, due, at, lo, hi = self.state.get()
            n = len(s.alpha)
            s.alpha, s.days, s.resid = np.asarray(alpha, float), list(days), [float(r) for r in resid]
            s.waiting = [(d, a, np.asarray(lo[i * n:(i + 1) * n], float), np.asarray(hi[i * n:(i + 1) * n], float)) for i, (d, a) in enumerate(zip(due, at))]
        return s

    def _save(self, s: ConformalState) -> None:
        # only the look-back window is needed again
        keep = int(np.searchsorted(s.days, s.days[-1] - s.window_days - s.lag_days - 1)) if s.days else 0
        flat = lambda k: [float(v) for w in s.waiting for v in w[k]]                          # noqa: E731
        self.state.update(([float(a) for a in s.alpha], [int(d) for d in s.days[keep:]], [float(r) for r in s.resid[keep:]], [int(w[0]) for w in s.waiting],
                           [int(w[1]) - keep for w in s.waiting], flat(2), flat(3)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("day", kind="stable")
        s = self._load()
        out = []
        for day, mean, y in zip(pdf["day"].astype(int), pdf["mean"].astype(float), pd.to_numeric(pdf["y"], errors="coerce").astype(float)):
            q = s.step(int(day), mean, y)
            out.append([key[0], int(day), mean, *([None] * len(QCOLS) if q is None else q)])
        self._save(s)
        yield pd.DataFrame(out, columns=["series", "day", "mean", *QCOLS])

    def close(self) -> None:
        pass


def conformal_stream(stream: DataFrame, **options) -> DataFrame:
    """(series, day, mean, y) in day order per series -> quantiles.  `y` of a row is only used from day + lag on."""
    schema = "series string, day int, mean double, " + ", ".join(f"{c} double" for c in QCOLS)
    return stream.groupBy("series").transformWithStateInPandas(_Conformal(**options), schema, outputMode="Append", timeMode="None")


def upsert_days(stream: DataFrame, path: str, keys: list[str], order: list[str], day: str, checkpoint: str):
    """Sink of daily outputs: `latest_copies` under the name that the live chain uses; rows of a day may come in several batches."""
    return latest_copies(stream, path, keys, order, day, checkpoint)
