"""Run registry on Parquet: what happened to runs as an append-only log of events, and tables whose slots are replaced whole.

A table (predictions, scores, artifacts, live days) is a folder of generations, each written once and never changed, and a manifest that names the
current generation of each slot (a run's fold, a run, a signal's day).  A write puts its rows into a new generation and, when all of them are there, adds the
slots to the manifest in one small file.  Readers go by the manifest, so they see a slot before or after a write and never a mixture; a job that is
retried or runs twice leaves an unused generation behind, which `sweep` removes.

Readers name the files of the manifest and the generations they stand for one by one.  Spark takes two scans of one folder for the same scan, whatever the folder held when
each was planned, and may answer both from one exchange: a plan that joined a table read before a write with one read after it would lose the rows of the later one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.operators.audit import checksum_diff, column_checksums, content_hash
from wattline.operators.scoring import melt_scores

EVENTS = ("run_id string, model string, config_json string, config_hash string, panel_rows bigint, created_utc timestamp, event_utc timestamp, "
          "status string, error string, panel_hash string")
RUNNING, DONE, FAILED, EXPLORATORY = "running", "done", "failed", "exploratory"


@dataclass(frozen=True)
class Event:
    """One line of a run's log; a run is what its latest line says."""

    run_id: str
    model: str
    config_json: str
    config_hash: str
    panel_rows: int | None
    created_utc: datetime
    event_utc: datetime
    status: str
    error: str | None = None
    panel_hash: str | None = None

    @classmethod
    def of(cls, model: str, config: dict, status: str, at: datetime | None = None, **more) -> Event:
        """The first line of a new run."""
        at = at or datetime.now(UTC)
        digest = hashlib.sha256(json.dumps({"model": model, **config}, sort_keys=True, default=str).encode()).hexdigest()
        return cls(f"{model}-{at:%Y%m%dT%H%M%S%f}-{digest}-{uuid.uuid4().hex}", model, json.dumps(config, sort_keys=True, default=str), digest, more.pop("panel_rows", None), at, at, status, **more)

    def then(self, status: str, error: str | None = None, at: datetime | None = None) -> Event:
        return replace(self, event_utc=at or datetime.now(UTC), status=status, error=error)


class Table:
    """A table of slots, replaced whole; `slots` are the columns that name one."""

    def __init__(self, spark: SparkSession, root: str, slots: tuple[str, ...]):
        self.spark, self.root, self.slots = spark, root, slots

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _manifest(self) -> DataFrame:
        return self.spark.read.parquet(*files_now(self.spark, f"{self.root}/manifest"))

    def write(self, df: DataFrame) -> str:
        """Replace the slots that df has; returns the generation."""
        generation = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex}"
        path = f"{self.root}/rows/generation={generation}"
        df.write.partitionBy(*self.slots).parquet(path)
        named = self.spark.read.parquet(path).select(*[F.col(c).cast("string").alias(c) for c in self.slots]).distinct()
        named.withColumn("generation", F.lit(generation)).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return generation

    def current(self) -> DataFrame:
        """(slots as text, generation): the manifest's latest word on each slot.  Generations sort by time."""
        return self._manifest().groupBy(*self.slots).agg(F.max("generation").alias("generation"))

    def _used(self, current: DataFrame) -> list[str]:
        """Generations that some slot needs: at most one for each write that is still in force."""
        return sorted(r[0] for r in current.select("generation").distinct().collect())

    def read(self, *only) -> DataFrame:
        """Current rows; columns that a generation lacks are NULL.  `only`: conditions on the slot columns, which prune folders."""
        current = self.current()
        folders = [f"{self.root}/rows/generation={g}" for g in self._used(current)]
        rows = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.root}/rows").parquet(*folders)
        for condition in only:
            rows = rows.where(condition)
        now = current.select("generation", *[F.col(c).alias(f"_{c}") for c in self.slots])
        same = rows["generation"] == now["generation"]
        for c in self.slots:
            same = same & F.col(c).cast("string").eqNullSafe(F.col(f"_{c}"))
        return rows.join(now, same, "left_semi").drop("generation")

    def sweep(self) -> int:
        """Delete the generations that no slot needs; for times when nobody writes or reads."""
        used = self._used(self.current())
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = fs_path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [f.getPath() for f in store.listStatus(fs_path(f"{self.root}/rows")) if f.getPath().getName().removeprefix("generation=") not in used]
        for path in old:
            store.delete(path, True)
        return len(old)


class Registry:
    """Folder layout: events/, predictions/, scores/, artifacts/<name>/, live/<name>/ as tables of slots, panels/<hash>/."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str, *slots: str) -> Table:
        return Table(self.spark, f"{self.root}/{name}", slots)

    # ---------------------------------------------------------------- runs

    def record(self, event: Event) -> Event:
        """The only way into the log."""
        self.spark.createDataFrame([astuple(event)], EVENTS).write.mode("append").parquet(f"{self.root}/events")
        return event

    @contextmanager
    def running(self, model: str, config: dict, panel: DataFrame | None = None, panel_rows: int | None = None, panel_hash: str | None = None) -> Iterator[str]:
        """A run while it goes on: its id inside, done or failed after.  `panel_hash` names a panel that is kept already."""
        event = self.record(Event.of(model, config, RUNNING, panel_rows=panel_rows, panel_hash=self.keep_panel(panel) if panel is not None else panel_hash))
        try:
            yield event.run_id
        except Exception as e:
            self.record(event.then(FAILED, f"{type(e).__name__}: {e}"))
            raise
        self.record(event.then(DONE))

    def runs(self) -> DataFrame:
        """Latest state of every run."""
        return latest_state(self.spark.read.schema(EVENTS).parquet(*files_now(self.spark, f"{self.root}/events")))

    def latest_runs(self, models: list[str] | None = None) -> DataFrame:
        done = self.runs().filter(F.col("status") == DONE)
        done = done if models is None else done.filter(F.col("model").isin(models))
        return latest_per_model(done)

    def configs_tried(self) -> DataFrame:
        """Different configurations in the log; one tried informally (an event of status `exploratory`) counts too."""
        return self.runs().agg(F.count_distinct("config_hash").alias("configs"))

    # ---------------------------------------------------------------- outputs of runs

    def save_predictions(self, run_id: str | None, pred: DataFrame) -> None:
        """All folds of a run in one job; `fold` is a column of `pred`.  Without `run_id` the rows name their runs."""
        self.table("predictions", "run_id", "fold").write(pred if run_id is None else pred.withColumn("run_id", F.lit(run_id)))

    def save_scores(self, run_id: str | None, scores: DataFrame, ids: tuple = ("fold", "market", "component", "zone")) -> None:
        named = scores if run_id is None else scores.withColumn("run_id", F.lit(run_id))
        self.table("scores", "run_id").write(melt_scores(named, ["run_id", *ids]))

    def save_artifact(self, run_id: str, name: str, df: DataFrame) -> None:
        self.table(f"artifacts/{name}", "run_id", "fold").write(df.withColumn("run_id", F.lit(run_id)))

    def predictions(self, *run_ids: str) -> DataFrame:
        """One or more runs; the run filter prunes folders."""
        return self.table("predictions", "run_id", "fold").read(F.col("run_id").isin(list(run_ids)))

    def scores(self) -> DataFrame:
        return self.table("scores", "run_id").read()

    def artifact(self, run_id: str, name: str) -> DataFrame:
        return self.table(f"artifacts/{name}", "run_id", "fold").read(F.col("run_id") == run_id).drop("run_id")

    # ---------------------------------------------------------------- panels

    def keep_panel(self, panel: DataFrame, keys: tuple = ("ts_utc", "zone")) -> str:
        """Store the panel once per content and return its hash."""
        sums = column_checksums(panel, list(keys)).persist()
        h = content_hash(sums).first()["content_hash"]
        own = self.table(f"panels/{h}", "part")
        if not own._exists():
            own.write(panel.withColumn("part", F.lit("panel")))
            self.table(f"panels/{h}/columns", "part").write(sums.withColumn("part", F.lit("columns")))
        sums.unpersist()
        return h

    def panel_of(self, run_id: str) -> DataFrame:
        return self.table(f"panels/{self._panel_hash(run_id)}", "part").read().drop("part")

    def panel_diff(self, run_a: str, run_b: str) -> DataFrame:
        a, b = (self.table(f"panels/{self._panel_hash(r)}/columns", "part").read().drop("part") for r in (run_a, run_b))
        return checksum_diff(a, b)

    def _panel_hash(self, run_id: str) -> str:
        r = self.runs().filter(F.col("run_id") == run_id).select("panel_hash").first()
        if r is None or r[0] is None:
            raise ValueError(f"{run_id} has no panel snapshot")
        return r[0]

    # ---------------------------------------------------------------- live tables

    def replace_days(self, table: str, df: DataFrame, keys: tuple = ("signal", "delivery_date")) -> None:
        """Replace the (signal, day) slots present in `df`; other days stay."""
        self.table(f"live/{table}", *keys).write(df)

    def live(self, table: str, keys: tuple = ("signal", "delivery_date")) -> DataFrame:
        return self.table(f"live/{table}", *keys).read()

    def append_once(self, table: str, df: DataFrame, key: str) -> None:
        """Append rows whose key is not stored yet (a declared test is scored once)."""
        own = self.table(f"live/{table}", key)
        if own._exists():
            df = df.join(own.read().select(key), key, "left_anti")
        if not df.isEmpty():
            own.write(df)


def files_now(spark: SparkSession, folder: str) -> list[str]:
    """The data files that a folder has now."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().toString() for f in listed if not f.getPath().getName().startswith(("_", ".")))


def latest_state(events: DataFrame) -> DataFrame:
    cols = [c for c in events.columns if c != "run_id"]
    g = events.groupBy("run_id").agg(F.max_by(F.struct(*cols), F.struct("event_utc", F.col("status") != "running")).alias("_r"))
    return g.select("run_id", "_r.*")


def latest_per_model(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model").agg(F.max_by("run_id", F.struct("created_utc", "run_id")).alias("run_id"))


