"""Daily live forecast: base models under the month's fold, history, recipe steps, one delivery day out."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.clock import issue_time
from wattline.operators.reshape import targets_long
from wattline.plans.backtest import Model
from wattline.plans.folds import Fold, month_fold, next_month
from wattline.plans.postprocess import add_history_days
from wattline.plans.recipes import SIGNAL, SIGNAL_RECIPE, Recipe, Source
from wattline.plans.registry import Registry
from wattline.settings import PRED_KEYS, QCOLS

HISTORY_DAYS = 460


def folds_between(first: date, last: date) -> list[Fold]:
    out, m = [], first.replace(day=1)
    while m <= last:
        out.append(month_fold(m))
        m = next_month(m)
    return out


def base_forecast(model: Model, panel: DataFrame, day: date) -> DataFrame:
    """Point forecast of one day under its month's fold; later panel rows are never read."""
    f = month_fold(day)
    only = Fold(f.name, f.train_start, f.train_end, day, day + timedelta(days=1))
    known = panel.filter(F.col("delivery_date") <= F.lit(day))
    return model.fit_predict(known, [only]).filter(F.col("delivery_date") == F.lit(day)).select(*PRED_KEYS, "mean")


def day_forecast(base_history: dict[str, DataFrame], base_today: dict[str, DataFrame], panel: DataFrame, day: date, signal: str = SIGNAL, recipe: Recipe = SIGNAL_RECIPE) -> DataFrame:
    """Signal rows of `day`: stored history and earlier live days plus today's base forecasts, through the recipe."""
    since = day - timedelta(days=HISTORY_DAYS)
    outcomes = targets_long(panel)
    base = {n: add_history_days(h.filter(F.col("delivery_date") >= F.lit(since)), base_today[n], outcomes) for n, h in base_history.items()}
    rows = recipe.frame(Source(base, panel, folds_between(since, day)))
    out = rows.filter(F.col("delivery_date") == F.lit(day)).select(*PRED_KEYS, "mean", *QCOLS)
    return out.withColumns({"issue_utc": issue_time(F.col("delivery_date")), "signal": F.lit(signal)})


def publish(registry: Registry, table: str, rows: DataFrame, now: datetime | None = None, keys: tuple = ("signal", "delivery_date")) -> None:
    registry.replace_days(table, rows.withColumn("created_utc", F.lit(now or datetime.now(UTC))), keys)


def spike_today(model, panel: DataFrame, day: date) -> DataFrame:
    """Spike risk of one day, trained with the rule of its month."""
    f = month_fold(day)
    only = Fold(f.name, f.train_start, f.train_end, day, day + timedelta(days=1))
    rows = model.fit_predict(panel.filter(F.col("delivery_date") <= F.lit(day)), [only])
    return rows.select(F.lit(model.name).alias("model"), issue_time(F.col("delivery_date")).alias("issue_utc"), "delivery_date", "ts_utc", "zone", "hour_local",
                       "p_spike", "thr", "mean", *QCOLS)
