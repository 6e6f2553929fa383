"""Labelled documents that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.langid import held_out


def learnable(labels: DataFrame, label: str, modulus: int, rest: int) -> DataFrame:
    """(doc_id, y): one row for each labelled doc_id that is not held out; of contradicting labels the larger counts."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(~held_out(modulus, rest))
            .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))


def bounded(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """About `most` rows (doc_id, y) at most, chosen by a hash of doc_id; half of them of the rarer class where it has as many."""
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, most / 2 / n) for y, n in counts.items()}
    part = F.when(F.col("y") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < part * (1 << 30)).withColumn("weight", 1 / part)
