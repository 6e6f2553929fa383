"""Generalised Pareto fits of many groups at once, by sums that merge.

The profile likelihood of theta = shape / scale only needs the mean of log(1 + theta e) over a group.  Each pass adds these up in the tasks for a grid of
trial values of every group, Spark sums the arrays, and the grid closes in on the best value; the number of passes is fixed.  So a group may be of any size, and
the pooled group is one more group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.session import cut_lineage

GRID, PASSES = 201, 6


def _sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of log(1 + theta e) for each group's trial values, a row for each group and task."""
    total: dict[int, np.ndarray] = {}
    for b in it:
        g, e, lo, hi = (b.column(c).to_numpy() for c in ("g", "e", "lo", "hi"))
        for k in np.unique(g):
            at = np.flatnonzero(g == k)
            theta = np.linspace(lo[at[0]], hi[at[0]], GRID)
            for i in range(0, len(at), 4096):
                part = np.log1p(np.clip(theta[:, None] * e[at[i:i + 4096]][None, :], -1 + 1e-12, None)).sum(axis=1)
                total[k] = total[k] + part if k in total else part
    if total:
        n = len(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(total), np.int64), GRID)), pa.array(np.tile(np.arange(GRID, dtype=np.int32), n)), pa.array(np.concatenate(list(total.values())))], ["g", "i", "s"])


def gpd_fits(rows: DataFrame, by: list[str], excess: str) -> DataFrame:
    """(by, xi, sigma, n) of the positive excesses of each group; NULL keys are groups too.  Groups of fewer than two have shape 0 and their mean (or 1)."""
    e = F.when(F.col(excess) > 0, F.col(excess).cast("double"))
    key = F.xxhash64(*[F.to_json(F.struct(*by), {"ignoreNullFields": "false"})])
    laid = cut_lineage(rows.select(*by, key.alias("g"), e.alias("e")))
    groups = laid.groupBy("g", *by).agg(F.count("e").alias("n"), F.avg("e").alias("mean"), F.max("e").alias("top"))
    groups = cut_lineage(groups.select("*", (-0.999 / F.col("top")).alias("lo"), (20 / F.col("mean")).alias("hi")))
    values, found = laid.where("e IS NOT NULL").select("g", "e"), groups.where("n >= 2")
    for _ in range(PASSES):
        sums = values.join(found.select("g", "lo", "hi"), "g").mapInArrow(_sums, "g bigint, i int, s double").groupBy("g", "i").agg(F.sum("s").alias("s"))
        theta = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (GRID - 1)
        flat = F.abs(theta) * F.col("mean") < 1e-8
        k = F.col("s") / F.col("n")
        value = F.when(flat, -F.ln("mean") - 1).otherwise(F.when(k / theta > 0, -F.ln(k / theta) - k - 1))
        best = sums.join(found, "g").groupBy("g").agg(F.max(F.when(value.isNotNull(), F.struct(value.alias("v"), (-F.col("i")).alias("i"), k.alias("k"), flat.alias("flat"), theta.alias("theta")))).alias("b"))
        step = (F.col("hi") - F.col("lo")) / (GRID - 1)
        at = lambda i: F.col("lo") + step * i                                            # noqa: E731
        found = found.drop("xi", "sigma").join(best, "g").withColumns({
            "xi": F.when(F.col("b.flat"), 0.0).otherwise(F.col("b.k")), "sigma": F.when(F.col("b.flat"), F.col("mean")).otherwise(F.col("b.k") / F.col("b.theta")),
            "_lo": at(F.greatest(-F.col("b.i") - 2, F.lit(0))), "_hi": at(F.least(-F.col("b.i") + 2, F.lit(GRID - 1)))})
        found = cut_lineage(found.withColumns({"lo": F.col("_lo"), "hi": F.col("_hi")}).drop("b", "_lo", "_hi"))
    few = groups.where("n < 2").select(*by, F.lit(0.0).alias("xi"), F.coalesce("mean", F.lit(1.0)).alias("sigma"), "n")
    return found.select(*by, "xi", "sigma", "n").unionByName(few)
