"""Feed files as a Spark data source, batch and stream: format `feed_files`.

`load(folder)` gives the rows that `feeds.parse_feed` takes: (_file, _date, _pos, header, cells).  Filters on `_date` prune files by the date in their
names before any is opened; a partition is a run of files of about `bytesPerPartition`.  The stream's offset is the (modification time, name) of the
last file taken, so corrected files that are put in place of old ones are read again, and a replayed batch takes the same files.

Options: feed (name in FEEDS, or none for all CSV files), bytesPerPartition (64 MB), sep.  Folders are opened by pyarrow's file systems; for stores that
only Spark reads use `feeds.read_feed`.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from wattline.settings import MARKET_TZ
from wattline.sources.feeds import FEEDS, OLD_HEADERS, curate

ROWS = "_file string, _date date, _pos bigint, header array<string>, cells array<string>"
_ARROW = pa.schema([("_file", pa.string()), ("_date", pa.date32()), ("_pos", pa.int64()), ("header", pa.list_(pa.string())), ("cells", pa.list_(pa.string()))])
BYTES, BATCH = 64 << 20, 8192


@dataclass
class File:
    path: str
    size: int
    changed: int                    # nanoseconds
    day: date | None

    @property
    def place(self) -> tuple[int, str]:
        return self.changed, self.path


@dataclass
class Files(InputPartition):
    """Some whole files."""

    uri: str
    paths: list[str]


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def day_in(name: str) -> date | None:
    m = re.match(r"(\d{8})", name)
    try:
        return datetime.strptime(m[1], "%Y%m%d").date() if m else None
    except ValueError:
        return None


def listed(folder: str, stem: str | None) -> list[File]:
    """CSV files of the feed in the folder, by name."""
    store, root = _opened(folder)
    found = []
    for info in store.get_file_info(fs.FileSelector(root)):
        fits = info.is_file and (re.fullmatch(rf"\d{{8}}{re.escape(stem)}\.csv", info.base_name) if stem else info.base_name.endswith(".csv"))
        if fits:
            found.append(File(info.path, info.size, info.mtime_ns, day_in(info.base_name)))
    return sorted(found, key=lambda f: f.path)


def dealt(folder: str, files: list[File], most: int) -> list[Files]:
    """Runs of files of about `most` bytes."""
    runs: list[list[File]] = []
    size = most
    for f in files:
        if size + f.size > most:
            runs.append([])
            size = 0
        runs[-1].append(f)
        size += f.size
    return [Files(folder, [f.path for f in run]) for run in runs]


def read_files(part: Files, sep: str) -> Iterator[pa.RecordBatch]:
    store, _ = _opened(part.uri)
    rows: list[tuple] = []
    for path in part.paths:
        name = path.rsplit("/", 1)[-1]
        day = day_in(name)
        with store.open_input_stream(path) as raw, io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline="") as text:
            header = None
            for at, line in enumerate(csv.reader(text, delimiter=sep, skipinitialspace=True)):
                cells = [c.strip() for c in line]
                if not any(cells):
                    continue
                if header is None:
                    header = [OLD_HEADERS.get(c, c) for c in cells]
                    continue
                rows.append((path, day, at, header, cells))
                if len(rows) >= BATCH:
                    yield _batch(rows)
                    rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Range:
    """Bounds on a file's date, from filters that are taken over whole."""

    def __init__(self):
        self.low, self.high, self.among = None, None, None

    def take(self, f: Filter) -> bool:
        if getattr(f, "attribute", None) != ("_date",):
            return False
        if isinstance(f, EqualTo):
            self.among = {f.value} if self.among is None else self.among & {f.value}
        elif isinstance(f, In):
            self.among = set(f.value) if self.among is None else self.among & set(f.value)
        elif isinstance(f, GreaterThanOrEqual | GreaterThan):
            edge = (f.value, isinstance(f, GreaterThan))
            self.low = edge if self.low is None else max(self.low, edge)
        elif isinstance(f, LessThanOrEqual | LessThan):
            edge = (f.value, not isinstance(f, LessThan))
            self.high = edge if self.high is None else min(self.high, edge)
        else:
            return False
        return True

    def holds(self, day: date | None) -> bool:
        if self.low is None and self.high is None and self.among is None:
            return True
        if day is None:                                  # a comparison with no date is not true
            return False
        if self.among is not None and day not in self.among:
            return False
        if self.low is not None and (day < self.low[0] or (self.low[1] and day == self.low[0])):
            return False
        return self.high is None or day < self.high[0] or (self.high[1] and day == self.high[0])


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.stem, self.sep, self.most, self.range = *_settings(options), _Range()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.range.take(f):
                yield f

    def partitions(self) -> list[Files]:
        return dealt(self.folder, [f for f in listed(self.folder, self.stem) if self.range.holds(f.day)], self.most) or [Files(self.folder, [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(partition, self.sep)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.stem, self.sep, self.most = _settings(options)

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max((f.place for f in listed(self.folder, self.stem)), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        return dealt(self.folder, [f for f in listed(self.folder, self.stem) if low < f.place <= high], self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return read_files(partition, self.sep)


def _settings(options: dict) -> tuple[str, str | None, str, int]:
    feed = options.get("feed")
    return options["path"], FEEDS[feed].stem if feed else None, options.get("sep", ","), int(options.get("bytespartition", options.get("bytesPerPartition", BYTES)))


class FeedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_files"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedFiles)
    return spark


def feed_rows(spark: SparkSession, folder: str, feed: str | None = None, **options) -> DataFrame:
    """Rows of the feed's files in a folder; filter `_date` to prune files."""
    reader = register(spark).read.format("feed_files").options(**{k: str(v) for k, v in options.items()})
    return (reader.option("feed", feed) if feed else reader).load(folder)


def feed_row_stream(spark: SparkSession, folder: str, feed: str | None = None, **options) -> DataFrame:
    reader = register(spark).readStream.format("feed_files").options(**{k: str(v) for k, v in options.items()})
    return (reader.option("feed", feed) if feed else reader).load(folder)


def load_feed(spark: SparkSession, folder: str, feed: str, first: date | None = None, last: date | None = None, tz: str = MARKET_TZ) -> DataFrame:
    """The curated feed from the files dated first .. last; other files are not opened."""
    rows = feed_rows(spark, folder, feed)
    if first is not None:
        rows = rows.where(rows["_date"] >= first)
    if last is not None:
        rows = rows.where(rows["_date"] <= last)
    return curate(rows.drop("_date"), FEEDS[feed], tz)
