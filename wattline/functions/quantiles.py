"""Expressions over a forecast row that carries its quantile columns q01..q99."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from wattline.operators.kernels import pit_rows, ppf_rows
from wattline.settings import QCOLS, QUANTILES

# every level owns the cell between the midpoints to its neighbours; the outer edges are 0 and 1
_EDGES = [0.0, *[(a + b) / 2 for a, b in zip(QUANTILES, QUANTILES[1:])], 1.0]
CELL_WIDTHS = [b - a for a, b in zip(_EDGES, _EDGES[1:])]


def qarray(prefix: str = "", cols: list[str] | None = None) -> Column:
    return F.array(*[F.col(f"{prefix}{c}").cast("double") for c in (cols or QCOLS)])


def spread_array(arr: Column, prefix: str = "") -> list[Column]:
    return [arr[i].alias(f"{prefix}{c}") for i, c in enumerate(QCOLS)]


def pinball(y: Column, q: Column, level: float) -> Column:
    d = y - q
    return F.greatest(F.lit(level) * d, F.lit(level - 1) * d)


def has_quantiles(prefix: str = "") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{prefix}{c}").isNotNull() for c in QCOLS])


def _loss_sum(y: Column, prefix: str, weights: list[float]) -> Column:
    """Weighted sum of the 21 pinball losses as one array expression: unrolled, it outgrows the 64 KB limit of a generated
    method and the whole stage loses code generation."""
    spec = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(w).alias("w")) for q, w in zip(QUANTILES, weights)])
    terms = F.zip_with(qarray(prefix), spec, lambda q, s: F.greatest(s["q"] * (y - q), (s["q"] - 1) * (y - q)) * s["w"])
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def crps(y: Column, prefix: str = "") -> Column:
    """Row CRPS by the midpoint rule; NULL when any level is missing (a NULL term makes the sum NULL)."""
    return F.lit(2.0) * _loss_sum(y, prefix, CELL_WIDTHS)


def pinball_mean(y: Column, prefix: str = "") -> Column:
    return _loss_sum(y, prefix, [1.0 / len(QCOLS)] * len(QCOLS))


def covered(y: Column, lo: str, hi: str) -> Column:
    return F.when(F.col(lo).isNotNull() & F.col(hi).isNotNull(), y.between(F.col(lo), F.col(hi)).cast("double"))


def monotone(df: DataFrame, prefix: str = "") -> DataFrame:
    """Sort every quantile row ascending."""
    names = [f"{prefix}{c}" for c in QCOLS]
    q = qarray(prefix)
    row = F.when(F.exists(q, lambda x: x.isNull()), q).otherwise(F.sort_array(q))
    return df.withColumn("_q", row).withColumns({c: F.col("_q")[i] for i, c in enumerate(names)}).drop("_q")


def distribution_mean(prefix: str = "") -> Column:
    inner = QCOLS[1:-1]
    return reduce(add, [F.col(f"{prefix}{c}") for c in inner]) / F.lit(float(len(inner)))


def distribution_scale(prefix: str = "") -> Column:
    return (F.col(f"{prefix}q95") - F.col(f"{prefix}q05")) / F.lit(3.29)


def mixture_mean(base: Column, other: Column, p: Column) -> Column:
    w = F.coalesce(p, F.lit(0.0))
    return (F.lit(1.0) - w) * base + w * F.coalesce(other, base)


def mean_present(*cols: Column) -> Column:
    """Row mean over the non-NULL inputs."""
    arr = F.filter(F.array(*cols), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), F.size(arr))


def median_present(*cols: Column) -> Column:
    """Row median over the non-NULL inputs."""
    arr = F.sort_array(F.filter(F.array(*cols), lambda x: x.isNotNull()))
    n = F.size(arr)
    lo = F.greatest(F.floor((n - 1) / 2), F.lit(0)).cast("int")
    hi = F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(arr, lo) + F.get(arr, hi)) / F.lit(2.0))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.vstack(col.to_numpy()).astype(float) if len(col) else np.empty((0, len(QCOLS)))


@F.pandas_udf(DoubleType())
def pit(y: pd.Series, q: pd.Series) -> pd.Series:
    """Probability integral transform of the outcome under the row's quantiles."""
    return pd.Series(pit_rows(y.to_numpy(float), _matrix(q)))


@F.pandas_udf(ArrayType(DoubleType()))
def ppf(u: pd.Series, q: pd.Series) -> pd.Series:
    """Quantile function of the row at the levels in `u`."""
    if not len(u):
        return pd.Series([], dtype=object)
    return pd.Series(list(ppf_rows(np.vstack(u.to_numpy()).astype(float), _matrix(q))))
