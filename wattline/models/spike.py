"""Real-time spike member: probability of a price above the zone's trailing threshold, and the size of the excess."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline import settings as S
from wattline.functions.numeric import gpd_quantile
from wattline.operators.logistic import Logit, fit_logits, next_slot_loss
from wattline.operators.scoring import brier, log_loss, with_total
from wattline.operators.tails import gpd_fits
from wattline.plans.folds import Fold, assign_test_fold, spread_history
from wattline.session import cut_lineage
from wattline.settings import QCOLS, QUANTILES

# fixed values: trailing spans, decay and the member's features
LEVEL, THRESHOLD_DAYS, EXCESS_DAYS, MIN_SPIKES = 0.95, 365, 730, 50
DECAY, DECAY_DAYS = 0.7, 30
STORM = ["storm", "storm_x_load", "hrrr_lightning_zone", "hrrr_cape_zone"]
BASE = ["rt_spin_max_24h", "rt_spin_mean_24h", "rt_shortage_7d", "da_spin_max_d1", "spike_d2_h", "spike_decay", "spike_freq7",
        "load_surprise_zone", "load_surprise_system", "hrrr_cdh", "hrrr_hdh", "dam_outages_d", "dam_outages_345_d", "gas_hh",
        "lag_da_d1_total", "rt_d2_std"]
VARIANTS = {"full": BASE + STORM, "no_storm": BASE}
PENALTIES = (0.003, 0.01, 0.03, 0.1, 0.3)


def frame(panel: DataFrame, zones: list[str] = S.INTERNAL_ZONES) -> DataFrame:
    d = panel.filter(F.col("zone").isin(zones))
    t = F.coalesce("hrrr_temp_zone", "temp_fcst_zone")
    pos = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))                   # noqa: E731
    zero = F.lit(0.0)
    d = d.withColumns({"hrrr_cdh": pos(t - S.BASE_TEMP_C), "hrrr_hdh": pos(F.lit(S.BASE_TEMP_C) - t),
                       "storm": F.coalesce("hrrr_cape_zone", zero) / 1000 * F.coalesce("hrrr_refl40_zone", zero),
                       "hour_block": F.floor(F.col("hour_local") / 4).cast("int")})
    return d.withColumn("storm_x_load", F.col("storm") * F.col("load_fcst_zone") / 1000)


def thresholds(d: DataFrame, folds: list[Fold], level: float = LEVEL, days: int = THRESHOLD_DAYS) -> DataFrame:
    """(fold, zone, thr): bounded groups (hours of a year), so the built-in percentile is exact and safe."""
    hist = spread_history(d.select("delivery_date", "zone", "rt_total"), folds, days, from_train_start=True)
    return hist.groupBy("fold", "zone").agg(F.percentile("rt_total", F.lit(level)).alias("thr"))


def history_features(d: DataFrame, thr: DataFrame, last_lag: int = DECAY_DAYS + 1) -> tuple[DataFrame, DataFrame]:
    """Per fold: daily decayed count and 7-day frequency of spike days up to D-2, and the D-2 flag of the same hour.

    Each spike day is laid onto the days it still influences (lags 2 .. 31), so there is no range join.
    """
    cell = d.groupBy("zone", "delivery_date", "hour_local").agg(F.avg("rt_total").alias("_v")).filter("_v IS NOT NULL")
    flag = cell.join(thr, "zone").withColumn("_s", (F.col("_v") >= F.col("thr")).cast("double"))
    day = flag.groupBy("fold", "zone", "delivery_date").agg(F.max("_s").alias("_any"))
    span = day.groupBy("fold", "zone").agg(F.min("delivery_date").alias("_a"), F.max("delivery_date").alias("_b"))
    spine = span.select("fold", "zone", "_a", "_b", F.explode(F.sequence("_a", "_b")).alias("delivery_date"))
    laid = day.filter("_any > 0").withColumn("_k", F.explode(F.sequence(F.lit(2), F.lit(last_lag)))).select(
        "fold", "zone", F.date_add("delivery_date", F.col("_k")).alias("delivery_date"), F.pow(F.lit(DECAY), F.col("_k") - 2).alias("_w"),
        (F.col("_k") <= 8).cast("double").alias("_recent"))
    sums = laid.groupBy("fold", "zone", "delivery_date").agg(F.sum("_w").alias("_decay"), F.sum("_recent").alias("_n7"))
    # days of the 7-day window (lags 2 .. 8) that lie inside the calendar
    width = F.greatest(F.least(F.datediff("delivery_date", "_a") - 1, F.lit(7)), F.lit(0))
    full = F.datediff("delivery_date", "_a") >= last_lag
    daily = spine.join(sums, ["fold", "zone", "delivery_date"], "left").select(
        "fold", "zone", "delivery_date", F.when(full, F.coalesce("_decay", F.lit(0.0))).otherwise(F.lit(0.0)).alias("spike_decay"),
        F.coalesce(F.try_divide(F.coalesce("_n7", F.lit(0.0)), width), F.lit(0.0)).alias("spike_freq7"))
    hourly = flag.select("fold", "zone", F.date_add("delivery_date", 2).alias("delivery_date"), "hour_local", F.col("_s").alias("spike_d2_h"))
    return daily, hourly


def labelled(d: DataFrame, folds: list[Fold]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, thresholds), all folds at once, with history features relative to each fold's thresholds."""
    thr = thresholds(d, folds)
    daily, hourly = history_features(d, thr)

    def add(rows: DataFrame) -> DataFrame:
        j = rows.join(daily, ["fold", "zone", "delivery_date"], "left").join(hourly, ["fold", "zone", "delivery_date", "hour_local"], "left")
        return j.join(thr, ["fold", "zone"], "left").withColumn("spike", F.coalesce((F.col("rt_total") >= F.col("thr")).cast("double"), F.lit(0.0)))

    train = add(spread_history(d, folds, from_train_start=True)).filter("rt_total IS NOT NULL")
    return train, add(assign_test_fold(d, folds).drop("train_end")), thr


def _inputs(features: list[str], zones: list[str]) -> Column:
    """Raw features and the dummies of zone and hour block, as one array."""
    return F.array(*[F.col(c).cast("double") for c in features], *[(F.col("zone") == z).cast("double") for z in zones[1:]], *[(F.col("hour_block") == b).cast("double") for b in range(1, 6)])


def excess_parameters(train: DataFrame, days: int = EXCESS_DAYS, min_spikes: int = MIN_SPIKES) -> DataFrame:
    """(fold, zone, xi, sigma): generalised Pareto fit of the excess per zone, pooled where a zone has too few."""
    last = train.groupBy("fold").agg(F.max("delivery_date").alias("_l"))
    e = train.join(last, "fold").filter((F.col("delivery_date") > F.date_sub("_l", days)) & (F.col("rt_total") > F.col("thr")))
    e = e.select("fold", "zone", (F.col("rt_total") - F.col("thr")).alias("e"))

    # the pool of a fold is one more group, of any size
    fits = gpd_fits(e.unionByName(e.withColumn("zone", F.lit(None).cast("string"))), ["fold", "zone"], "e")
    zonal, pooled = fits.where("zone IS NOT NULL"), fits.where("zone IS NULL")
    keys = train.select("fold", "zone").distinct()
    j = keys.join(zonal, ["fold", "zone"], "left").join(pooled.select("fold", F.col("xi").alias("_xi"), F.col("sigma").alias("_s")), "fold")
    own = F.col("n") >= min_spikes
    return j.select("fold", "zone", F.when(own, F.col("xi")).otherwise(F.col("_xi")).alias("xi"), F.when(own, F.col("sigma")).otherwise(F.col("_s")).alias("sigma"))


def excess_quantiles(df: DataFrame) -> DataFrame:
    """Spike-conditional quantiles and mean from thr, xi, sigma; the mean is capped at the last quantile."""
    cols: dict[str, Column] = {c: F.col("thr") + gpd_quantile(F.lit(q), F.col("xi"), F.col("sigma")) for c, q in zip(QCOLS, QUANTILES)}
    out = df.withColumns(cols)
    top = F.col(QCOLS[-1]) - F.col("thr")
    mean = F.when(F.col("xi") < 0.9, F.col("sigma") / (F.lit(1.0) - F.least(F.col("xi"), F.lit(0.9)))).otherwise(top)
    return out.withColumn("mean", F.col("thr") + F.least(mean, top))


class SpikeModel:
    def __init__(self, variant: str = "full", zones: list[str] = S.INTERNAL_ZONES, penalties: tuple = PENALTIES):
        self.name = "spike_full" if variant == "full" else f"spike_{variant}"
        self.features, self.zones, self.penalties = VARIANTS[variant], zones, penalties

    def fit_predict(self, panel: DataFrame, folds: list[Fold]) -> DataFrame:
        """All folds are labelled in one plan; all their logistic fits, over penalties and quarters, share each pass over the training rows."""
        train, test, _ = labelled(frame(panel, self.zones), folds)
        train = cut_lineage(train)
        params = excess_parameters(train)
        width = len(self.features) + len(self.zones) - 1 + 5
        stats = train.groupBy("fold").agg(F.min("delivery_date").alias("_a"), (F.datediff(F.max("delivery_date"), F.min("delivery_date")) + 1).alias("_span"),
                                          F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in self.features]).alias("_m"),
                                          F.array(*[F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)) for c in self.features]).alias("_s"))
        stats = cut_lineage(stats)
        raw, own = _inputs(self.features, self.zones), len(self.features)
        moved = F.transform(F.col("_raw"), lambda v, i: F.coalesce(F.when(i < own, (v - F.get("_m", i)) / F.get("_s", i)).otherwise(v), F.lit(0.0)))
        ready = lambda rows: rows.join(stats, "fold").withColumn("_raw", raw).withColumn("_x", moved)     # noqa: E731
        rows = ready(train).select("fold", F.floor(F.datediff("delivery_date", "_a") * 4 / F.col("_span")).cast("int").alias("slot"), F.col("_x").alias("x"), F.col("spike").alias("y"))
        rows = cut_lineage(rows)
        chosen = {f.name: self.penalties[0] for f in folds}
        if len(self.penalties) > 1:                                      # learn from the first k quarters, test on the next
            trial = [Logit(f.name, k, 1.0 / c) for f in folds for c in self.penalties for k in (1, 2, 3)]
            loss = np.nan_to_num(next_slot_loss(rows, trial, fit_logits(rows, trial, width), width)).reshape(len(folds), len(self.penalties), 3).sum(axis=2)
            chosen = {f.name: self.penalties[int(i)] for f, i in zip(folds, loss.argmin(axis=1), strict=True)}
        final = [Logit(f.name, 4, 1.0 / chosen[f.name]) for f in folds]
        beta = fit_logits(rows, final, width)
        table = panel.sparkSession.createDataFrame([(f.group, [float(v) for v in b[1:]], float(b[0])) for f, b in zip(final, beta, strict=True)], "fold string, _b array<double>, _b0 double")
        z = F.aggregate(F.zip_with("_x", "_b", lambda x, w: x * w), F.col("_b0"), lambda s, v: s + v)
        out = ready(test).join(table, "fold").withColumn("p_spike", 1 / (1 + F.exp(-z)))
        q = excess_quantiles(out.drop("_x", "_raw", "_b", "_b0", "_m", "_s", "_a", "_span").join(params, ["fold", "zone"]))
        return q.select("fold", "delivery_date", "ts_utc", "zone", "hour_local", F.lit("rt").alias("market"), F.lit("total").alias("component"),
                        F.col("rt_total").alias("y"), F.col("score_rt").alias("scored"), "mean", *QCOLS, "p_spike", "thr", "xi", "sigma", "spike", "spike_d2_h")


def spike_scores(pred: DataFrame, climatology: DataFrame) -> DataFrame:
    """Brier score and log loss of the member, the zone's training rate and D-2 persistence, by zone and ALL."""
    rows = pred.filter(F.col("scored") & F.col("y").isNotNull()).join(climatology, ["fold", "zone"], "left")
    clip = lambda x: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), x))                 # noqa: E731
    rows = rows.withColumns({"_p": clip(F.col("p_spike")), "_c": clip(F.col("clim")), "_r": clip(F.coalesce("spike_d2_h", F.lit(0.0)) * 0.5 + 0.02)})
    hit = F.col("spike")
    return with_total(rows).groupBy("fold", "zone").agg(
        F.avg(hit).alias("base_rate"), brier(F.col("_p"), hit).alias("brier"), brier(F.col("_c"), hit).alias("brier_clim"),
        brier(F.col("_r"), hit).alias("brier_persist"), log_loss(F.col("_p"), hit).alias("logloss"), log_loss(F.col("_c"), hit).alias("logloss_clim"),
        log_loss(F.col("_r"), hit).alias("logloss_persist"))


def climatology(train: DataFrame) -> DataFrame:
    return train.groupBy("fold", "zone").agg(F.avg("spike").alias("clim"))

