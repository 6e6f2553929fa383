"""Sparse-matrix operators over long tables: Gram matrices, ridge factors, co-occurrence, drift.

A Gram matrix over a bounded set of columns is summed per task first: every task folds its observation rows into one
small K x K block, and only those blocks are shuffled.  Pairs inside an observation never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators.kernels import ridge_solve, subspace_angle
from wattline.operators.ordered import top_per_group


def top_keys(df: DataFrame, by: list[str], key: str, value: str, k: int = 60) -> DataFrame:
    """(by, key, sum_abs, rank): the k keys with the largest sum of |value| per group; ties by key."""
    sums = df.groupBy(*by, key).agg(F.sum(F.abs(value)).alias("sum_abs"))
    return top_per_group(sums, by, [F.desc("sum_abs"), F.asc(key)], k)


def _collect_rows(df: DataFrame, by: list[str], obs: list[str], col: str, value: str) -> DataFrame:
    """One row per observation with its sparse entries; `col` ids come from a bounded catalogue, so a row is short."""
    pre = df.groupBy(*by, *obs, col).agg(F.sum(value).alias("_v"))
    return pre.groupBy(*by, *obs).agg(F.collect_list(F.struct(F.col(col).alias("c"), F.col("_v").alias("v"))).alias("_e"))


def gram(df: DataFrame, by: list[str], obs: list[str], col: str, value: str, width: int, count: bool = False) -> DataFrame:
    """(by, i, j, v) with i <= j: the Gram matrix of the sparse rows, `col` being integers in [0, width).

    `count=True` counts joint occurrences instead of summing products.  Summation order inside a task is the row order;
    across tasks it is a sum aggregate.
    """
    rows = _collect_rows(df, by, obs, col, value).select(*by, "_e")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name in by}
    schema = ", ".join([*[f"`{b}` {types[b]}" for b in by], "i int", "j int", "v double"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in (pdf.groupby(by, sort=False) if by else [((), pdf)]):
                key = key if isinstance(key, tuple) else (key,)
                x = np.zeros((len(part), width))
                for r, entries in enumerate(part["_e"]):
                    for e in entries:
                        x[r, e["c"]] = 1.0 if count else e["v"]
                block = blocks.setdefault(key, np.zeros((width, width)))
                block += x.T @ x
        for key, block in blocks.items():
            i, j = np.nonzero(np.triu(block))
            yield pd.DataFrame({**{b: [k] * len(i) for b, k in zip(by, key)}, "i": i.astype("int32"), "j": j.astype("int32"),
                                "v": block[i, j]})

    partial = rows.mapInPandas(fold, schema)
    return partial.groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def cross_products(x: DataFrame, y: DataFrame, by: list[str], obs: list[str], col: str, xv: str, target: str, yv: str) -> DataFrame:
    """(by, col, target, v): X'Y as a join on the observation key and a sum."""
    return x.join(y, [*by, *obs]).groupBy(*by, col, target).agg(F.sum(F.col(xv) * F.col(yv)).alias("v"))


def ridge_factors(x: DataFrame, y: DataFrame, by: list[str], obs: list[str], col: str, xv: str, target: str, yv: str, width: int,
                  ridge: float = 1.0) -> DataFrame:
    """(by, target, col, a) = (X'X + ridge I)^-1 X'Y.

    The Gram matrix is folded on the tasks; the K x K system (K = catalogue size) is solved per group and block of
    targets.  Observations with no entry in X add nothing to either product, so they are never stored.
    """
    g = gram(x, by, obs, col, xv, width).groupBy(*by).agg(F.collect_list(F.struct("i", "j", "v")).alias("_g"))
    xy = cross_products(x, y, by, obs, col, xv, target, yv).groupBy(*by, target).agg(F.collect_list(F.struct(F.col(col).alias("c"), "v")).alias("_xy"))
    joined = xy.join(g, by) if by else xy.join(g)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name in [*by, target]) + f", `{col}` int, a double"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                key = tuple(row[b] for b in by)
                if key not in cache:
                    m = np.zeros((width, width))
                    for e in row["_g"]:
                        m[e["i"], e["j"]] = m[e["j"], e["i"]] = e["v"]
                    cache = {key: m}
                v = np.zeros(width)
                for e in row["_xy"]:
                    v[e["c"]] = e["v"]
                a = ridge_solve(cache[key], v, ridge)
                out.append(pd.DataFrame({**{b: row[b] for b in by}, target: row[target], col: np.arange(width, dtype="int32"), "a": a}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return joined.mapInPandas(solve, schema)


def in_window_r2(x: DataFrame, y: DataFrame, factors: DataFrame, by: list[str], obs: list[str], col: str, xv: str, target: str, yv: str) -> DataFrame:
    """(by, target, r2): fit of the factors on their own window; hours without any entry in X are predicted as 0."""
    pred = x.join(factors, [*by, col]).groupBy(*by, *obs, target).agg(F.sum(F.col(xv) * F.col("a")).alias("_p"))
    j = y.join(pred, [*by, *obs, target], "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
    e = F.col(yv) - F.col("_p")
    g = j.groupBy(*by, target).agg(F.sum(e * e).alias("_res"), F.var_pop(yv).alias("_var"), F.count(yv).alias("_n"))
    tot = F.col("_var") * F.col("_n")
    return g.withColumn("r2_in_window", F.when(tot > 0, F.lit(1.0) - F.col("_res") / F.greatest(tot, F.lit(1e-12)))).drop("_res", "_var", "_n")


def cobinding(df: DataFrame, catalogue: DataFrame, by: list[str], obs: list[str], key: str, k: int, min_both: int = 24) -> DataFrame:
    """(by, key_a, key_b, hours_both, jaccard): how often two catalogue keys are active in the same observation.

    `catalogue` holds at most k keys per group with `rank` 1..k; key_a is the better ranked of the two.
    """
    idx = catalogue.select(*by, key, (F.col("rank") - 1).cast("int").alias("_c"))
    active = df.join(idx, [*by, key]).select(*by, *obs, "_c").distinct().withColumn("_one", F.lit(1.0))
    g = gram(active, by, obs, "_c", "_one", k, count=True)
    diag = g.filter("i = j").select(*by, F.col("i").alias("_d"), F.col("v").alias("_n"))
    pair = g.filter("i < j")
    pair = pair.join(diag.select(*by, F.col("_d").alias("i"), F.col("_n").alias("_na")), [*by, "i"]).join(
        diag.select(*by, F.col("_d").alias("j"), F.col("_n").alias("_nb")), [*by, "j"])
    union = F.col("_na") + F.col("_nb") - F.col("v")
    named = (pair.filter(F.col("v") >= min_both)
             .join(idx.select(*by, F.col(key).alias("key_a"), F.col("_c").alias("i")), [*by, "i"])
             .join(idx.select(*by, F.col(key).alias("key_b"), F.col("_c").alias("j")), [*by, "j"]))
    return named.select(*by, "key_a", "key_b", F.col("v").cast("bigint").alias("hours_both"),
                        F.when(union > 0, F.col("v") / union).otherwise(F.lit(0.0)).alias("jaccard"))


def consecutive(df: DataFrame, by: list[str], period: str) -> DataFrame:
    """(by, previous, current) periods in order; one row per period, so the window is small."""
    p = df.select(*by, period).distinct()
    w = Window.partitionBy(*by).orderBy(period)
    return p.withColumn("_prev", F.lag(period).over(w)).filter("_prev IS NOT NULL")


def key_drift(catalogue: DataFrame, by: list[str], period: str, key: str) -> DataFrame:
    """Catalogue overlap of consecutive periods: Jaccard index, keys added and dropped."""
    steps = consecutive(catalogue, by, period)
    cur = catalogue.select(*by, period, key).distinct()
    now = cur.join(steps, [*by, period]).select(*by, period, F.col(key).alias("_k"), F.lit(1).alias("_now"))
    old = cur.withColumnRenamed(period, "_prev").join(steps, [*by, "_prev"]).select(*by, period, F.col(key).alias("_k"), F.lit(1).alias("_old"))
    j = now.join(old, [*by, period, "_k"], "full")
    both = F.count_if(F.col("_now").isNotNull() & F.col("_old").isNotNull())
    return j.groupBy(*by, period).agg((both / F.count(F.lit(1))).alias("catalog_jaccard"), F.count_if(F.col("_old").isNull()).alias("keys_added"),
                                      F.count_if(F.col("_now").isNull()).alias("keys_dropped"))


def matrix_drift(factors: DataFrame, by: list[str], period: str, row: str, key: str, value: str = "a", inner_rows: bool = False,
                 out: str = "rel_change") -> DataFrame:
    """Relative Frobenius change of the factor matrix between consecutive periods over the keys both have.

    Rows are the previous period's (a row that disappears counts as 0), or the common ones with `inner_rows`.
    """
    steps = consecutive(factors, by, period)
    now = factors.join(steps.select(*by, period), [*by, period]).select(*by, period, row, key, F.col(value).alias("_new"))
    old = factors.withColumnRenamed(period, "_prev").join(steps, [*by, "_prev"]).select(*by, period, row, key, F.col(value).alias("_old"))
    common = now.select(*by, period, key).distinct().join(old.select(*by, period, key).distinct(), [*by, period, key])
    old, now = old.join(common, [*by, period, key], "left_semi"), now.join(common, [*by, period, key], "left_semi")
    if inner_rows:
        rows = now.select(*by, period, row).distinct().join(old.select(*by, period, row).distinct(), [*by, period, row])
        old, now = (d.join(rows, [*by, period, row], "left_semi") for d in (old, now))
        j = old.join(now, [*by, period, row, key], "full")
    else:
        j = old.join(now, [*by, period, row, key], "left")
    a, b = F.coalesce("_old", F.lit(0.0)), F.coalesce("_new", F.lit(0.0))
    return j.groupBy(*by, period).agg((F.sqrt(F.sum((b - a) * (b - a))) / F.greatest(F.sqrt(F.sum(a * a)), F.lit(1e-9))).alias(out))


def subspace_drift(factors: DataFrame, by: list[str], period: str, row: str, key: str, value: str = "a", k: int = 8) -> DataFrame:
    """Angle (degrees) between the leading k-dimensional subspaces of consecutive factor matrices.

    One group holds two matrices of (nodes x catalogue keys); both sides are bounded by the node list and the catalogue.
    """
    steps = consecutive(factors, by, period)
    now = factors.join(steps.select(*by, period), [*by, period]).select(*by, period, row, key, F.col(value).alias("new"))
    old = factors.withColumnRenamed(period, "_prev").join(steps, [*by, "_prev"]).select(*by, period, row, key, F.col(value).alias("old"))
    j = now.join(old, [*by, period, row, key])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in j.schema.fields if f.name in [*by, period]) + ", angle_deg double"

    def angle(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.pivot_table(index=row, columns=key, values="old").fillna(0.0).sort_index()
        b = pdf.pivot_table(index=row, columns=key, values="new").reindex(index=a.index, columns=a.columns).fillna(0.0)
        v = subspace_angle(a.to_numpy(), b.to_numpy(), k) if min(a.shape) >= k else None
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in [*by, period]}, "angle_deg": [v]})

    return j.groupBy(*by, period).applyInPandas(angle, schema)
