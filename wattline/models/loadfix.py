"""Correction of the published load forecast from what the weather forecast learned since it was made."""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline import settings as S
from wattline.operators.boosting import Fit, Options, boost, predict
from wattline.session import cut_lineage
from wattline.operators.scoring import with_total
from wattline.plans.folds import Fold, assign_test_fold, month_fold, month_starts, spread_history

LEVEL = ["hrrr_temp_zone", "hrrr_dewpoint_zone", "hrrr_wind80_zone", "hrrr_cloud_zone", "hrrr_temp_zone_dmean", "hrrr_temp_zone_dmax",
         "hrrr_temp_zone_dmin", "hrrr_temp_system"]
CHANGE = ["d_temp", "d_cdh", "d_hdh"]
CALENDAR = ["hour_local", "dow", "month", "is_weekend", "is_holiday", "doy_sin", "doy_cos"]
WEATHER_FEATURES = ["load_fcst_zone", "temp_fcst_zone_file", "hrrr_cdh", "hrrr_hdh", *LEVEL, *CHANGE, *CALENDAR]
CALENDAR_FEATURES = ["load_fcst_zone", *CALENDAR]
BLOCKS = 4


def frame(panel: DataFrame, load_5m: DataFrame, forecast_d1: DataFrame, zones: list[str] = S.INTERNAL_ZONES) -> DataFrame:
    """Panel rows with the actual load, the later benchmark forecast, weather changes and the target r = actual / forecast - 1."""
    actual = load_5m.groupBy("zone", F.date_trunc("hour", "ts_utc").alias("ts_utc")).agg(F.avg("load_mw").alias("load_actual"))
    bench = forecast_d1.select("zone", "ts_utc", F.col("load_forecast_mw").alias("isolf_d1"))
    d = panel.filter(F.col("zone").isin(zones)).join(actual, ["zone", "ts_utc"], "left").join(bench, ["zone", "ts_utc"], "left")
    new, old = F.col("hrrr_temp_zone"), F.col("temp_fcst_zone_file")
    pos = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))                   # noqa: E731
    base = F.lit(S.BASE_TEMP_C)
    d = d.withColumns({"hrrr_cdh": pos(new - base), "hrrr_hdh": pos(base - new)})
    return d.withColumns({"d_temp": new - old, "d_cdh": F.col("hrrr_cdh") - pos(old - base), "d_hdh": F.col("hrrr_hdh") - pos(base - old),
                          "r": F.try_divide("load_actual", "load_fcst_zone") - 1})


def linear_terms(d: DataFrame) -> DataFrame:
    """array column `x`: intercept, free day, then per 6-hour block an intercept and five weather terms."""
    block = F.floor(F.col("hour_local") / 6)
    terms = [F.col("d_cdh"), F.col("d_hdh"), F.col("d_temp"), F.col("hrrr_dewpoint_zone") * (F.col("hrrr_cdh") > 0).cast("double"),
             F.col("hrrr_cloud_zone") / 100]
    cols = [F.lit(1.0), (F.col("is_weekend") | F.col("is_holiday")).cast("double")]
    for b in range(BLOCKS):
        on = (block == b).cast("double")
        cols += [on, *[F.coalesce(t * on, F.lit(0.0)) for t in terms]]
    return d.withColumn("x", F.array(*[c.cast("double") for c in cols]))


def linear_correction(d: DataFrame, folds: list[Fold], alpha: float = 1.0) -> DataFrame:
    """r_hat from a ridge per (fold, zone).

    Normal equations are sums of outer products: each task folds its rows into one small matrix per key, so a key's rows
    never meet in one task.
    """
    x = linear_terms(d)
    usable = x.filter(F.col("r").isNotNull() & F.col("load_fcst_zone").isNotNull() & F.col("hrrr_temp_zone").isNotNull())
    hist = spread_history(usable.select("delivery_date", "zone", "x", "r"), folds, from_train_start=True).select("fold", "zone", "x", "r")

    def outer(batches):
        acc: dict[tuple, list] = {}
        for pdf in batches:
            for key, g in pdf.groupby(["fold", "zone"], sort=False):
                m = np.vstack(g["x"])
                a = acc.setdefault(key, [np.zeros((m.shape[1],) * 2), np.zeros(m.shape[1])])
                a[0] += m.T @ m
                a[1] += m.T @ g["r"].to_numpy()
        for (fold, zone), (gm, xy) in acc.items():
            yield pd.DataFrame({"fold": [fold], "zone": [zone], "g": [gm.ravel()], "v": [xy]})

    parts = hist.mapInPandas(outer, "fold string, zone string, g array<double>, v array<double>")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sum(np.vstack(pdf["v"]), axis=0)
        g = np.sum(np.vstack(pdf["g"]), axis=0).reshape(len(v), len(v))
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "zone": [pdf["zone"].iloc[0]], "beta": [np.linalg.solve(g + alpha * np.eye(len(v)), v)]})

    coef = parts.groupBy("fold", "zone").applyInPandas(solve, "fold string, zone string, beta array<double>")
    test = assign_test_fold(x, folds).drop("train_end")
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    have = F.col("hrrr_temp_zone").isNotNull() & F.col("load_fcst_zone").isNotNull()
    return _predictions(test.join(coef, ["fold", "zone"], "left").withColumn("r_hat", F.when(have, dot).otherwise(F.lit(0.0))).drop("x", "beta"))


def _predictions(d: DataFrame) -> DataFrame:
    return d.withColumns({"r_hat": F.coalesce("r_hat", F.lit(0.0)), "isolf_d2": F.col("load_fcst_zone")}).withColumn(
        "pred", F.col("load_fcst_zone") * (1 + F.col("r_hat")))


def tree_correction(d: DataFrame, folds: list[Fold], weather: bool = True, n_trees: int = 600, depth: int = 6, learning_rate: float = 0.03,
                    zones: list[str] = S.INTERNAL_ZONES, min_rows: int = 200) -> DataFrame:
    """r_hat from boosted trees pooled over zones, the trees of all folds grown together; weather=False is the calendar-only ablation."""
    features = WEATHER_FEATURES if weather else CALENDAR_FEATURES
    number = lambda day: (day - date(1970, 1, 1)).days                                   # noqa: E731
    code = F.array_position(F.array(*[F.lit(z) for z in zones]), F.col("zone")).cast("int")
    ok = F.col("r").isNotNull() & F.col("load_fcst_zone").isNotNull() & F.col("hrrr_temp_zone").isNotNull()
    rows = cut_lineage(d.withColumns({"id": F.xxhash64("ts_utc", "zone"), "day": F.unix_date("delivery_date"), "part": code, "y": F.array(F.when(ok, F.col("r").cast("double"))),
                                      "x": F.array(*[F.col(c).cast("double") for c in features], code.cast("double"))}).where("part > 0"))
    fits = [Fit((f.name,), 0, number(f.train_start), number(f.train_end), number(f.test_start), number(f.test_end)) for f in folds]
    options = Options("l2", n_trees, depth, learning_rate, min_rows, bins=127, rows=0.8, features=1.0)
    made = predict(rows, boost(rows.select("id", "day", "part", "x", "y"), fits, len(features) + 1, 1, options), options)
    names = F.array(*[F.lit(f.name) for f in folds])
    have = F.col("hrrr_temp_zone").isNotNull() & F.col("load_fcst_zone").isNotNull()
    part = rows.join(made.select("id", F.get(names, F.col("fit")).alias("fold"), F.col("mean").alias("_p")), "id")
    return _predictions(part.withColumn("r_hat", F.when(have, F.col("_p")).otherwise(F.lit(0.0))).drop("_p", "id", "day", "part", "x", "y"))


def debias(pred: DataFrame, d: DataFrame, folds: list[Fold]) -> DataFrame:
    """Benchmarks scaled by their mean ratio to the actual load per zone and hour over the fold's training days."""
    hist = spread_history(d, folds, from_train_start=True)
    ratio = hist.groupBy("fold", "zone", "hour_local").agg(F.avg(F.try_divide("load_actual", "load_fcst_zone")).alias("_b2"),
                                                           F.avg(F.try_divide("load_actual", "isolf_d1")).alias("_b1"))
    j = pred.join(ratio, ["fold", "zone", "hour_local"], "left")
    return j.withColumns({"isolf_d2_adj": F.col("load_fcst_zone") * F.coalesce("_b2", F.lit(1.0)),
                          "isolf_d1_adj": F.col("isolf_d1") * F.coalesce("_b1", F.lit(1.0))}).drop("_b1", "_b2")


def load_scores(pred: DataFrame, by: list[str], n_zones: int = len(S.INTERNAL_ZONES), system: str = S.SYSTEM_ZONE) -> DataFrame:
    """MAPE and RMSE of the model and the benchmarks by zone, pooled (ALL) and for the system sum (all zones required)."""
    cols = [c for c in ("pred", "isolf_d2", "isolf_d1", "isolf_d2_adj", "isolf_d1_adj") if c in pred.columns]
    keep = [*by, "zone", "load_actual", *cols]
    full = lambda c: F.when(F.count(c) >= n_zones, F.sum(c)).alias(c)                   # noqa: E731
    total = pred.groupBy(*by, "ts_utc").agg(*[full(c) for c in ["load_actual", *cols]]).withColumn("zone", F.lit(system)).dropna()
    rows = with_total(pred.select(*keep)).unionByName(total.select(*keep)).dropna(subset=["load_actual", "pred", "isolf_d2"])
    aggs = []
    for c in cols:
        tag = "" if c == "pred" else f"_{c}"
        e = F.col(c) - F.col("load_actual")
        aggs += [F.avg(F.abs(e) / F.col("load_actual")).alias(f"mape{tag}"), F.sqrt(F.avg(e * e)).alias(f"rmse{tag}")]
    return rows.groupBy(*by, "zone").agg(*aggs)


def oos_folds(first: date = date(2022, 10, 1), end: date = S.VALIDATION_END) -> list[Fold]:
    return [month_fold(m) for m in month_starts(first, end)]


def oos_table(pred: DataFrame, run_id: str) -> DataFrame:
    """Rows for load_fix_oos, the panel's out-of-sample corrected load."""
    return pred.select("ts_utc", "zone", "delivery_date", F.col("pred").alias("load_fix"), "r_hat", F.lit(run_id).alias("run_id"))

