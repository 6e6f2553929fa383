"""What the operators share: the registry, table access, staged tables in the shared folder, and Arrow text buffers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Runtime settings: small Arrow batches keep Python workers within a few hundred MB whatever the length of texts.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
    "spark.sql.parquet.compression.codec": "zstd",
}

NO_ID = -(1 << 63)                  # stands for a null id inside the operators; results show null again


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) -> DataFrame under `name`."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tuned(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  One is made only where none is set and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    folder = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def shown_id(column: str) -> Column:
    """The id as results show it."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string or binary column laid end to end, with each value's start and length; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    b = column.cast(pa.large_binary())
    if b.null_count:
        b = pc.fill_null(b, b"")
    offsets = np.frombuffer(b.buffers()[1], np.int64)[b.offset:b.offset + len(b) + 1] if len(b) else np.zeros(1, np.int64)
    raw = b.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets[:-1] - offsets[0], np.diff(offsets)


def strings_of(column: pa.Array) -> list[str]:
    """Values as str; null is empty, bytes that are no UTF-8 become U+FFFD."""
    return [(v or b"").decode("utf-8", "replace") if not isinstance(v, str) else v for v in column.to_pylist()]


def row_key() -> Column:
    """Tells rows of one doc_id apart, null included: a hash of the whole text.  Only rows with equal doc_id and equal text are one document."""
    return F.xxhash64(F.col("text").cast("binary"))


def text_input(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id never null, row as `row_key`, text as bytes, more...): only the columns that a task needs leave the JVM."""
    return docs.select(id_of("doc_id").alias("doc_id"), row_key().alias("row"), F.col("text").cast("binary").alias("text"), *more)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def without(docs: DataFrame, gone: DataFrame, kind: str = "left_anti") -> DataFrame:
    """docs without (or, left_semi, with only) the rows of the documents (doc_id, row) in `gone`; doc_id may be NO_ID there."""
    a, b = free_name(docs, "gone_id"), free_name(docs, "gone_row")
    listed = gone.select(F.col("doc_id").alias(a), F.col("row").alias(b))
    return docs.join(listed, (id_of("doc_id") == F.col(a)) & (row_key() == F.col(b)), kind)


def batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)
