"""Lag baselines and the zero-congestion climatology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.models.residuals import training_quantiles
from wattline.operators.reshape import targets_long
from wattline.plans.folds import Fold, assign_test_fold, spread_history
from wattline.settings import COMPONENTS, MARKETS, QCOLS

RULES = ("persist_da_d1", "weekly_da_d7", "lago_naive", "persist_rt_d2")
IDS = ["delivery_date", "ts_utc", "zone", "hour_local"]


def lag_forecast(rule: str, component: str) -> Column:
    """Point forecast of a rule; a missing lag falls back to D-1, then D-7."""
    d1, d7, rt2 = (F.col(f"lag_{p}_{component}") for p in ("da_d1", "da_d7", "rt_d2"))
    first = {"persist_da_d1": d1, "weekly_da_d7": d7, "persist_rt_d2": rt2,
             "lago_naive": F.when(F.col("dow").between(2, 5), d1).otherwise(d7)}[rule]
    return F.coalesce(first, d1, d7)


def long_forecast(panel: DataFrame, point: dict[tuple[str, str], Column], extra: list[str] | None = None) -> DataFrame:
    """{(market, component): column} -> long prediction rows."""
    rows = F.array(*[F.struct(F.lit(m).alias("market"), F.lit(c).alias("component"), v.cast("double").alias("mean"))
                     for (m, c), v in point.items()])
    return panel.select(*IDS, *(extra or []), F.explode(rows).alias("_r")).select(*IDS, *(extra or []), "_r.*")


class NaiveModel:
    """A lag rule with empirical residual quantiles.  `fit_predict` serves every fold in one job."""

    def __init__(self, rule: str, lookback_days: int = 365):
        if rule not in RULES:
            raise ValueError(rule)
        self.name, self.rule, self.lookback_days = rule, rule, lookback_days

    def config(self) -> dict:
        return {"rule": self.rule, "quantiles": "empirical_residual", "lookback_days": self.lookback_days}

    def points(self, panel: DataFrame, extra: list[str] | None = None) -> DataFrame:
        return long_forecast(panel, {(m, c): lag_forecast(self.rule, c) for m in MARKETS for c in COMPONENTS}, extra)

    def fit_predict(self, panel: DataFrame, folds: list[Fold]) -> DataFrame:
        test = self.points(assign_test_fold(panel, folds), ["fold"])
        truth = targets_long(panel).select("ts_utc", "zone", "market", "component", "y")
        recent = spread_history(panel, folds, self.lookback_days + 7, from_train_start=True)
        train = self.points(recent, ["fold"]).join(truth, ["ts_utc", "zone", "market", "component"])
        return training_quantiles(test, train, self.lookback_days)


class ZeroCongestion:
    """Always-zero congestion; its out-of-sample residual quantiles are the climatology."""

    name = "zero_congestion"

    def config(self) -> dict:
        return {"rule": "congestion = 0", "components": ["congestion"]}

    def fit_predict(self, panel: DataFrame, folds: list[Fold]) -> DataFrame:
        rows = long_forecast(assign_test_fold(panel, folds), {(m, "congestion"): F.lit(0.0) for m in MARKETS}, ["fold"])
        return rows.withColumns({c: F.lit(None).cast("double") for c in QCOLS})
