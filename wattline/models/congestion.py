"""Structural congestion: which constraints bind and at what shadow price, times the zones' shift factors, blended with
persistence.

The shadow-price table stays long and sparse.  A dense (day, hour, constraint) grid is only laid out for the catalogue of
the top constraints and the fold's window.
"""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.names import contingency_tokens, equipment_tokens, facility_tokens
from wattline.models.trees import assemble_features
from wattline.operators.scoring import brier, log_loss
from wattline.operators.sparse import ridge_factors, top_keys
from wattline.plans.folds import Fold
from wattline.settings import MARKETS

PUBLISHED_LAG = {"da": 1, "rt": 2}
SYSTEM_INPUTS = ["load_fcst_system", "temp_fcst_system", "gas_hh", "dow", "month"]
SLOT = ["d", "hr"]
HISTORY = ["bind_l", "mu_l", "bind_l7", "freq7_h", "freq30_h", "mu30_h", "freq_day_l", "da_bind_d1", "da_mu_d1", "da_freq7_h"]


def name_match(keys: DataFrame, equipment: DataFrame) -> DataFrame:
    """(key, equipment, side): constraints and equipment that share a station token; side is facility or contingency.

    Both sides are exploded to tokens and joined on the token, then reduced to distinct pairs.
    """
    k = keys.select("key", facility_tokens(F.col("key")).alias("facility"), contingency_tokens(F.col("key")).alias("contingency"))
    k = k.unpivot(["key"], ["facility", "contingency"], "side", "_t").withColumn("token", F.explode("_t")).select("key", "side", "token")
    e = equipment.select("equipment", F.explode(equipment_tokens(F.col("equipment"))).alias("token"))
    return k.join(e, "token").select("key", "equipment", "side").distinct()


def outage_lift(out_days: DataFrame, bind_days: DataFrame, n_days: DataFrame, by: list[str], shrink: float = 20.0, min_days: int = 10,
                max_share: float = 0.9) -> DataFrame:
    """Shrunk log ratio of a constraint's binding rate on days an equipment was expected out to its overall rate.

    `out_days` (by, d, equipment) and `bind_days` (by, d, key) are distinct; `n_days` (by, n) the training days; the
    catalogue's keys are those of `bind_days`.
    """
    n_e = out_days.groupBy(*by, "equipment").agg(F.count(F.lit(1)).cast("double").alias("n_out_days")).join(n_days, by)
    support = n_e.filter((F.col("n_out_days") >= min_days) & (F.col("n_out_days") <= F.col("n") * max_share))
    base = bind_days.groupBy(*by, "key").agg(F.count(F.lit(1)).cast("double").alias("_b")).join(n_days, by)
    p = F.greatest(F.lit(1.0) / F.col("n"), F.least(F.lit(1.0) - F.lit(1.0) / F.col("n"), F.col("_b") / F.col("n")))
    base = base.select(*by, "key", p.alias("base_rate"))
    joint = bind_days.join(out_days, [*by, "d"]).groupBy(*by, "key", "equipment").agg(F.count(F.lit(1)).cast("double").alias("bind_out_days"))
    pairs = base.join(support.drop("n"), by).join(joint, [*by, "key", "equipment"], "left").na.fill(0.0, ["bind_out_days"])
    lift = F.ln((F.col("bind_out_days") + shrink * F.col("base_rate")) / (F.col("n_out_days") + shrink)) - F.ln("base_rate")
    return pairs.withColumn("lift", lift)


def crossfit_lift(out_days: DataFrame, bind_days: DataFrame, days: DataFrame, blocks: int = 5, **kw) -> DataFrame:
    """(block, key, equipment, lift): lift tables fitted on the days outside each contiguous block.

    Every training day is spread over the other blocks, so all tables come from one aggregate.
    """
    w = Window.orderBy("d")
    numbered = days.select("d").distinct().withColumn("_i", F.row_number().over(w) - 1)
    n = numbered.count()
    block = F.floor(F.col("_i") * blocks / n).cast("int")
    others = numbered.select("d", F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(blocks - 1)), block)).alias("block"))
    size = others.groupBy("block").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return outage_lift(out_days.join(others, "d"), bind_days.join(others, "d"), size, ["block"], **kw)


def outage_features(expected: DataFrame, matches: DataFrame, lift: DataFrame | None) -> DataFrame:
    """(d, hr, key): name-matched outages expected out per side, and the largest positive and negative lift among them."""
    side = expected.join(matches, "equipment").groupBy(*SLOT, "key").agg(
        F.count_if(F.col("side") == "facility").cast("double").alias("out_fac"), F.count_if(F.col("side") == "contingency").cast("double").alias("out_ctg"))
    if lift is None:
        return side
    zero = F.lit(0.0)
    top = expected.join(lift.select("key", "equipment", "lift"), "equipment").groupBy(*SLOT, "key").agg(
        F.greatest(F.max("lift"), zero).alias("lift_max"), F.least(F.min("lift"), zero).alias("lift_min"))
    return side.join(top, [*SLOT, "key"], "full").na.fill(0.0)


def day_features(shadow: DataFrame, catalogue: DataFrame, market: str, first, last, system: DataFrame, outages: DataFrame) -> DataFrame:
    """Rows (d, hr, key) for every day in [first, last], hour and catalogue key, with history known at issue time.

    The history of one (key, hour) is a calendar-length series, so the trailing means are bounded windows.
    """
    lag = PUBLISHED_LAG[market]
    early = first - timedelta(days=40)
    grid = catalogue.select("key").distinct().select("key", F.explode(F.sequence(F.lit(early), F.lit(last))).alias("d")).withColumn(
        "hr", F.explode(F.sequence(F.lit(0), F.lit(23))))
    near = shadow.filter(F.col("d").between(F.lit(early), F.lit(last)))
    own = near.filter(F.col("market") == market).select(*SLOT, "key", F.col("mu"))
    da = near.filter(F.col("market") == "da").select(*SLOT, "key", F.col("mu").alias("mu_da"))
    g = grid.join(own, [*SLOT, "key"], "left").join(da, [*SLOT, "key"], "left").na.fill(0.0, ["mu", "mu_da"])
    g = g.withColumns({"_b": (F.col("mu") != 0).cast("double"), "_bd": (F.col("mu_da") != 0).cast("double")})
    w = Window.partitionBy("key", "hr").orderBy("d")
    back = lambda c, k, n: F.avg(c).over(w.rowsBetween(-(k + n - 1), -k))                # noqa: E731
    g = g.withColumns({"bind_l": F.lag("_b", lag).over(w), "mu_l": F.lag("mu", lag).over(w), "bind_l7": F.lag("_b", 7).over(w),
                       "freq7_h": back("_b", lag, 7), "freq30_h": back("_b", lag, 30), "mu30_h": back("mu", lag, 30),
                       "da_bind_d1": F.lag("_bd", 1).over(w), "da_mu_d1": F.lag("mu_da", 1).over(w), "da_freq7_h": back("_bd", 1, 7)})
    share = g.groupBy("key", F.date_add("d", lag).alias("d")).agg(F.avg("_b").alias("freq_day_l"))
    g = g.filter(F.col("d") >= F.lit(first)).join(share, ["key", "d"], "left").drop("_b", "_bd", "mu_da")
    return g.join(system, SLOT, "left").join(outages, "d", "left")


def _trees(cls, label: str, out: str, n: int, depth: int, min_rows: int):
    return cls(featuresCol="features", labelCol=label, predictionCol=out, maxIter=n, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8,
               minInstancesPerNode=min_rows, maxBins=127, seed=0)


def fit_hurdle(rows: DataFrame, features: list[str], n_trees: int = 300, depth: int = 6):
    """(classifier, regressor): P(bind), and the winsorised shadow price of binding rows."""
    x = rows.withColumn("_bind", (F.col("mu") != 0).cast("double"))
    lo, hi = x.filter("_bind = 1").agg(F.percentile("mu", F.array(F.lit(0.005), F.lit(0.995)))).first()[0]
    clf = GBTClassifier(featuresCol="features", labelCol="_bind", maxIter=n_trees, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8,
                        minInstancesPerNode=100, maxBins=127, seed=0).fit(x)
    bound = x.filter("_bind = 1").withColumn("_mu", F.least(F.greatest(F.col("mu"), F.lit(lo)), F.lit(hi)))
    return clf, _trees(GBTRegressor, "_mu", "_size", n_trees, depth, 50).fit(bound)


def apply_hurdle(rows: DataFrame, clf, reg) -> DataFrame:
    p = clf.transform(rows).withColumn("p_bind", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    p = reg.transform(p).withColumnRenamed("_size", "shadow_if_bind")
    return p.withColumn("shadow_forecast", F.col("p_bind") * F.col("shadow_if_bind"))


def zone_forecast(shadow_fc: DataFrame, factors: DataFrame) -> DataFrame:
    """(d, hr, zone, structural): shift factors times forecast shadow prices, summed over constraints."""
    return shadow_fc.join(factors, "key").groupBy(*SLOT, "zone").agg(F.sum(F.col("shadow_forecast") * F.col("a")).alias("structural"))


def blend_inputs(structural: DataFrame, congestion: DataFrame, market: str) -> DataFrame:
    """Structural forecast, day-ahead congestion of D-1 and, for real time, own congestion of D-2."""
    shift = lambda m, k, name: congestion.filter(F.col("market") == m).select(                       # noqa: E731
        F.date_add("d", k).alias("d"), "hr", "zone", F.col("cong").alias(name))
    out = structural.join(shift("da", 1, "da_d1"), [*SLOT, "zone"], "left")
    extra = [F.lit(0.0)]
    if market == "rt":
        out = out.join(shift("rt", PUBLISHED_LAG["rt"], "rt_d2"), [*SLOT, "zone"], "left")
        extra = [F.coalesce("rt_d2", F.lit(0.0))]
    return out.select(*SLOT, "zone", F.array(F.coalesce("structural", F.lit(0.0)), F.coalesce("da_d1", F.lit(0.0)), *extra).alias("x"))


def blend_weights(inputs: DataFrame, truth: DataFrame, loss: str = "lad") -> DataFrame:
    """(zone, intercept, w): least squares, or least absolute deviations by reweighting.

    A group is the pseudo out-of-sample hours of one zone (a fifth of the window), bounded by the calendar.
    """
    j = inputs.join(truth.select(*SLOT, "zone", "cong"), [*SLOT, "zone"]).filter("cong IS NOT NULL")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.vstack(pdf["x"]), pdf["cong"].to_numpy(float)
        a = np.column_stack([np.ones(len(y)), x])
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        if loss == "lad":
            for _ in range(60):
                w = 1 / np.maximum(np.abs(y - a @ beta), 1e-4)
                new = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
                done = np.abs(new - beta).max() < 1e-8
                beta = new
                if done:
                    break
        return pd.DataFrame({"zone": [pdf["zone"].iloc[0]], "intercept": [beta[0]], "w": [beta[1:]]})

    return j.select("zone", "x", "cong").groupBy("zone").applyInPandas(fit, "zone string, intercept double, w array<double>")


def blend(inputs: DataFrame, weights: DataFrame) -> DataFrame:
    dot: Column = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return inputs.join(weights, "zone").select(*SLOT, "zone", (F.col("intercept") + dot).alias("mean"))


def shift_factors(shadow: DataFrame, catalogue: DataFrame, congestion: DataFrame, target: str = "zone", value: str = "cong", ridge: float = 1.0,
                  by: list[str] | None = None, width: int = 60) -> DataFrame:
    """(by, target, key, a): ridge regression of congestion on the catalogue's hourly shadow prices.

    Hours where any target is missing are dropped, as one complete-case rule for all targets.
    """
    by = by or []
    idx = catalogue.select(*by, "key", (F.col("rank") - 1).cast("int").alias("_c"))
    x = shadow.join(idx, [*by, "key"]).select(*by, *SLOT, "_c", "mu")
    n = congestion.groupBy(*by).agg(F.count_distinct(target).alias("_all")) if by else congestion.agg(F.count_distinct(target).alias("_all"))
    have = congestion.filter(F.col(value).isNotNull()).groupBy(*by, *SLOT).agg(F.count(F.lit(1)).alias("_k"))
    full = (have.join(n, by) if by else have.join(n)).filter("_k = _all").select(*by, *SLOT)
    x, y = (t.join(full, [*by, *SLOT], "left_semi") for t in (x, congestion))
    f = ridge_factors(x, y, by, SLOT, "_c", "mu", target, value, width, ridge)
    return f.join(idx, [*by, "_c"]).select(*by, target, "key", "a")


class StructuralModel:
    """Fits one market and fold at a time (tree fits are Spark jobs); returns predictions and the fold's artifacts."""

    def __init__(self, name: str = "struct_cong", k: int = 60, window_days: int = 365, ridge: float = 1.0, n_trees: int = 300, depth: int = 6,
                 loss: str = "lad"):
        self.name, self.k, self.window_days, self.ridge, self.n_trees, self.depth, self.loss = name, k, window_days, ridge, n_trees, depth, loss

    def config(self) -> dict:
        return {"model": "structural congestion", "top_k": self.k, "window_days": self.window_days, "ridge": self.ridge, "trees": self.n_trees,
                "blend": self.loss}

    def _part(self, market: str, fit_first, fit_last, to_first, to_last, src: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
        own = src["shadow"].filter((F.col("market") == market) & F.col("d").between(F.lit(fit_first), F.lit(fit_last)))
        cat = top_keys(own, [], "key", "mu", self.k)
        cong = src["congestion"].filter((F.col("market") == market) & F.col("d").between(F.lit(fit_first), F.lit(fit_last))).drop("market")
        factors = shift_factors(own.drop("market"), cat, cong, ridge=self.ridge, width=self.k)
        rows = day_features(src["shadow"], cat, market, fit_first, to_last, src["system"], src["outages"])
        extra = [c for c in ("n_outages", "n_outages_345") if c in src["outages"].columns]
        rows = assemble_features(rows, [*HISTORY, "hr", *SYSTEM_INPUTS, *extra], None)
        clf, reg = fit_hurdle(rows.filter(F.col("d") <= F.lit(fit_last)), HISTORY, self.n_trees, self.depth)
        fc = apply_hurdle(rows.filter(F.col("d").between(F.lit(to_first), F.lit(to_last))), clf, reg)
        return blend_inputs(zone_forecast(fc, factors), src["congestion"], market), {"constraint_catalog": cat, "zone_shift_factors": factors}, fc

    def fit_predict_fold(self, src: dict[str, DataFrame], fold: Fold) -> tuple[DataFrame, dict[str, DataFrame]]:
        """`src`: shadow (market, d, hr, key, mu), congestion (market, d, hr, zone, cong), system (d, hr, inputs), outages (d, counts)."""
        end = fold.train_end - timedelta(days=1)
        start = end - timedelta(days=self.window_days - 1)
        cut = start + timedelta(days=int(self.window_days * 0.8))
        preds, art = [], {}
        for m in MARKETS:
            val, _, _ = self._part(m, start, cut - timedelta(days=1), cut, end, src)
            weights = blend_weights(val, src["congestion"].filter(F.col("market") == m).drop("market"), self.loss)
            x, tables, fc = self._part(m, start, end, fold.test_start, fold.test_end - timedelta(days=1), src)
            preds.append(blend(x, weights).withColumn("market", F.lit(m)))
            tables |= {"blend_weights": weights, "constraint_forecasts": fc.select("d", "hr", "key", "p_bind", "shadow_if_bind", "shadow_forecast",
                                                                                    F.col("mu").alias("shadow_actual"), "freq30_h")}
            for name, t in tables.items():
                t = t.withColumn("market", F.lit(m)).withColumn("fold", F.lit(fold.name))
                art[name] = art[name].unionByName(t, allowMissingColumns=True) if name in art else t
        return preds[0].unionByName(preds[1]).withColumn("fold", F.lit(fold.name)), art


def binding_scores(forecasts: DataFrame, by: list[str]) -> DataFrame:
    """Brier score and log loss of the binding probability against the 30-day hourly frequency."""
    hit = (F.col("shadow_actual") != 0).cast("double")
    clip = lambda x: F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), x))                 # noqa: E731
    p, c = clip(F.col("p_bind")), clip(F.col("freq30_h"))
    return forecasts.groupBy(*by).agg(F.avg(hit).alias("base_rate"), brier(p, hit).alias("brier"), brier(c, hit).alias("brier_clim"),
                                      log_loss(p, hit, 1e-3).alias("logloss"), log_loss(c, hit, 1e-3).alias("logloss_clim"))
