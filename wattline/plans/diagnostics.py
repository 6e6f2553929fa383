"""Diagnostics of a set of runs: daily losses, skill, overfitting statistics, scoreboard tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.quantiles import crps
from wattline.operators import overfit as O
from wattline.operators.scoring import daily_losses, ks_uniform
from wattline.operators.significance import coverage_tests, diebold_mariano, kupiec
from wattline.operators.reshape import pivot_values


def loss_table(pred: DataFrame, trial: str = "model") -> DataFrame:
    """(day, market, component, trial, crps, se, ae, n); store it once, reports only read this."""
    return daily_losses(pred, [trial, "market", "component"]).withColumnRenamed(trial, "trial")


def slice_losses(losses: DataFrame, market: str, component: str, loss: str) -> DataFrame:
    return losses.filter((F.col("market") == market) & (F.col("component") == component)).select("day", "trial", F.col(loss).alias("loss"), "n")


def dm_table(losses: DataFrame, benchmark: str, keys: list[str], value: str = "loss", day: str = "day") -> DataFrame:
    """(keys, trial, dm_stat, p_a_better, n_days, mean_diff) of every trial against the benchmark."""
    base = losses.filter(F.col("trial") == benchmark).select(*keys, day, F.col(value).alias("_b"))
    d = losses.filter(F.col("trial") != benchmark).join(base, [*keys, day])
    return diebold_mariano(d, [*keys, "trial"], day, value, "_b")


def per_trial(losses: DataFrame, benchmark: str, configs_tried: int | None = None) -> DataFrame:
    """Sharpe inference, Diebold-Mariano p and adjusted p per trial on the days complete for all."""
    skill = O.skill_matrix(losses, benchmark)
    others = skill.filter(F.col("trial") != benchmark)
    mo = O.moments(skill, ["trial"], "value")
    var = mo.filter(F.col("trial") != benchmark).agg(F.var_samp("sr").alias("var_sr"))
    rho = O.mean_pairwise_correlation(others)
    total = F.greatest(F.lit(float(configs_tried or 0)), F.col("n_trials"))
    scale = rho.select(O.implied_trials(F.col("rho"), total).alias("n_hat"), F.col("rho").alias("avg_trial_corr")).join(var)
    scale = scale.withColumn("sr0", O.expected_max_sr(F.col("var_sr"), F.col("n_hat")))
    j = mo.join(scale)
    sr, n, sk, ku = (F.col(c) for c in ("sr", "T", "skew", "kurt"))
    j = j.withColumns({"psr_0": O.psr(sr, n, sk, ku), "dsr": F.when(F.col("trial") != benchmark, O.psr(sr, n, sk, ku, F.col("sr0"))),
                       "min_trl_days_95": O.min_track_record(sr, sk, ku)})
    whole = O.complete_days(losses, "day", "trial", "loss")
    dm = dm_table(whole, benchmark, []).select("trial", F.col("p_a_better").alias("dm_p"))
    dm = O.bhy(O.holm(dm, [], "dm_p", "trial", "dm_p_holm"), [], "dm_p", "trial", "dm_p_bhy")
    return j.join(dm, "trial", "left")


def bundle(losses: DataFrame, benchmark: str, market: str, component: str = "total", loss: str = "crps", blocks: int = 16, draws: int = 2000,
           configs_tried: int | None = None) -> dict[str, DataFrame]:
    """All overfitting diagnostics for one market and benchmark."""
    s = slice_losses(losses, market, component, loss)
    skill = O.skill_matrix(s, benchmark)
    aligned = O.complete_days(s, "day", "trial", "loss").groupBy("day").agg(F.count_distinct("n").alias("k")).agg(
        F.coalesce(F.max("k") == 1, F.lit(True)).alias("rows_aligned"), F.count(F.lit(1)).alias("days"))
    return {"per_trial": per_trial(s, benchmark, configs_tried), "spa": O.spa_test(skill.filter(F.col("trial") != benchmark), draws),
            "pbo": O.pbo(skill, blocks), "alignment": aligned}


def fold_win_rate(scores: DataFrame, by: list[str]) -> DataFrame:
    """Share of folds that beat the reference and the median fold ratio (total price, all zones)."""
    s = scores.filter("metric = 'rmae' AND component = 'total' AND zone = 'ALL'")
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), F.avg((F.col("value") < 1).cast("double")).alias("frac_folds_beat_ref"),
                              F.median("value").alias("median_fold_rmae"))


def scoreboard(pred: DataFrame, losses: DataFrame, scores: DataFrame, benchmark: str, model: str = "model") -> dict[str, DataFrame]:
    """Pooled metrics, Diebold-Mariano by loss side by side, fold wins, interval tests."""
    from wattline.plans.backtest import pooled_summary

    parts = None
    for loss in ("crps", "se", "ae"):
        t = O.complete_days(losses.select("day", "market", "component", "trial", F.col(loss).alias("loss")).filter("loss IS NOT NULL"), "day", "trial", "loss")
        t = dm_table(t, benchmark, ["component", "market"]).withColumn("loss", F.lit(f"p_{loss}"))
        parts = t if parts is None else parts.unionByName(t)
    return {"pooled": pooled_summary(pred, [model]),
            "dm": pivot_values(parts, ["component", "market", "trial"], "loss", ["p_crps", "p_se", "p_ae"], "p_a_better"),
            "fold_stability": fold_win_rate(scores, [model, "market"]),
            "interval_tests": coverage_tests(pred.filter("scored AND component = 'total'"), [model, "market"])}


def scenario_report(spread_losses: DataFrame, spread_rows: DataFrame, base: str = "scen_indep", exclude: list[date] | None = None) -> dict[str, DataFrame]:
    """Spread CRPS against independent draws, and uniformity of the realised spread's rank."""
    t = spread_losses.filter(~F.col("day").isin(exclude)) if exclude else spread_losses
    return {"dm": O.holm(dm_table(t, base, []), [], "p_a_better", "trial", "holm_p"),
            "pit": ks_uniform(spread_rows, ["trial"], "pit").join(spread_rows.groupBy("trial").agg(
                F.avg(((F.col("pit") > 0.1) & (F.col("pit") < 0.9)).cast("double")).alias("share_in_10_90")), "trial")}


def tail_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """CRPS overall and in spike hours, and upper-tail miss rates at 95 % and 99 %."""
    y = F.col("y")
    head = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(crps(y)).alias("crps"), F.avg(F.when(F.col("spike") == 1, crps(y))).alias("crps_spike_hours"))
    for q, p in (("95", 0.05), ("99", 0.01)):
        k = kupiec(rows, by, y > F.col(f"q{q}"), p).select(*by, F.col("miss_rate").alias(f"miss{q}"), F.col("p_value").alias(f"kupiec_p{q}"))
        head = head.join(k, by)
    return head


def common_row_scores(frames: dict[str, DataFrame], truth: DataFrame, keys: list[str]) -> DataFrame:
    """Several models on exactly the rows they share: days, rows, CRPS, RMSE, 90 % coverage."""
    names = list(frames)
    shared = frames[names[0]].select(*keys)
    for n in names[1:]:
        shared = shared.join(frames[n].select(*keys), keys, "left_semi")
    out = None
    e = F.col("mean") - F.col("y")
    for n in names:
        j = frames[n].join(shared, keys, "left_semi").join(truth.select(*keys, "y").filter("y IS NOT NULL"), keys)
        s = j.groupBy("market").agg(F.count_distinct(F.to_date("ts_utc")).alias("days"), F.count(F.lit(1)).alias("n"), F.avg(crps(F.col("y"))).alias("crps"),
                                    F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.col("y").between(F.col("q05"), F.col("q95")).cast("double")).alias("cov90"))
        s = s.withColumn("model", F.lit(n))
        out = s if out is None else out.unionByName(s)
    return out
