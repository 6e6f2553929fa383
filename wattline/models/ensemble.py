"""Average of ensemble members' quantile forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.quantiles import distribution_mean, monotone
from wattline.settings import PRED_KEYS, QCOLS


def average_members(members: DataFrame) -> DataFrame:
    """Member rows (PRED_KEYS, member, quantiles) -> averaged, sorted quantiles; the point is the mean of q05 .. q95."""
    avg = members.groupBy(*PRED_KEYS).agg(*[F.avg(c).alias(c) for c in QCOLS])
    return monotone(avg).withColumn("mean", distribution_mean())
