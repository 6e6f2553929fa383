"""Predictive quantiles from past errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.plans.folds import Fold, assign_test_fold, spread_history
from wattline.settings import QCOLS, QUANTILES

CELL = ["market", "component", "zone", "hour_local"]
POOL = CELL[:-1]
MIN_OBS = 60


def _levels() -> Column:
    return F.array(*[F.lit(q) for q in QUANTILES])


def residual_tables(errors: DataFrame, by: list[str], min_obs: int = MIN_OBS, resid: str = "r") -> tuple[DataFrame, DataFrame]:
    """(cell table, pooled table) of residual quantiles per `by`.

    A cell is one value per day of the look-back; the pool adds the 24 hours.  Both are bounded by the calendar, so the
    exact built-in percentile is safe.
    """
    cell = errors.groupBy(*by, *CELL).agg(F.percentile(resid, _levels()).alias("_q"), F.count(resid).alias("_n"))
    pool = errors.groupBy(*by, *POOL).agg(F.percentile(resid, _levels()).alias("_qp"))
    return cell.filter(F.col("_n") >= min_obs).drop("_n"), pool


def attach_quantiles(pred: DataFrame, cell: DataFrame, pool: DataFrame, by: list[str]) -> DataFrame:
    """mean + residual quantiles of the row's cell, else of its pool, sorted."""
    base = pred.drop(*[c for c in QCOLS if c in pred.columns])
    j = base.join(cell, [*by, *CELL], "left").join(pool, [*by, *POOL], "left")
    row = F.sort_array(F.transform(F.coalesce("_q", "_qp"), lambda x: F.col("mean") + x))
    return j.withColumn("_row", row).select(*base.columns, *[F.col("_row")[i].alias(c) for i, c in enumerate(QCOLS)])


def training_quantiles(pred: DataFrame, train: DataFrame, lookback_days: int = 365, min_obs: int = MIN_OBS) -> DataFrame:
    """Quantiles from in-sample errors of the last `lookback_days` of each fold's training rows.

    `pred` and `train` both carry `fold`; `train` also y and mean.
    """
    t = train.filter(F.col("y").isNotNull() & F.col("mean").isNotNull())
    last = train.groupBy("fold").agg(F.max("delivery_date").alias("_last"))
    recent = t.join(last, "fold").filter(F.col("delivery_date") > F.date_sub("_last", lookback_days))
    cell, pool = residual_tables(recent.withColumn("r", F.col("y") - F.col("mean")), ["fold"], min_obs)
    return attach_quantiles(pred, cell, pool, ["fold"])


def oos_quantiles(pred: DataFrame, folds: list[Fold], lookback_days: int = 365, min_obs: int = MIN_OBS, by: list[str] | None = None) -> DataFrame:
    """Quantiles from the run's own earlier out-of-sample errors, for all folds (and all runs named by `by`) in one job.

    An error is usable by a fold when its day is before that fold's training end and within the look-back; a fold without
    history keeps NULL quantiles.
    """
    tagged = assign_test_fold(pred.drop("fold"), folds)
    past = tagged.filter(F.col("scored") & F.col("y").isNotNull() & F.col("mean").isNotNull())
    keys = ["fold", *(by or [])]
    past = past.select(*(by or []), "delivery_date", *CELL, (F.col("y") - F.col("mean")).alias("r"))
    hist = spread_history(past, folds, lookback_days)
    last = hist.groupBy(*keys).agg(F.max("delivery_date").alias("_last"))
    recent = hist.join(last, keys).filter(F.col("delivery_date") > F.date_sub("_last", lookback_days))
    cell, pool = residual_tables(recent, keys, min_obs)
    return attach_quantiles(tagged, cell, pool, keys).drop("train_end")
