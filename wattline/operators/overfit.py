"""Backtest-overfitting and multiple-testing statistics over a long table of daily skill (day, trial, value)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.numeric import norm_cdf, norm_ppf
from wattline.operators.resampling import Uniform, drawn_counts, position_index, resampled_sums
from wattline.session import cut_lineage

EULER_GAMMA = 0.5772156649015329


def moments(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """T, mean, sample std, Sharpe ratio, population skewness and raw kurtosis."""
    g = df.groupBy(*by).agg(F.count(x).alias("T"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                            F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))
    flat = ~(F.col("std") > 0)
    return g.withColumns({"sr": F.when(~flat, F.col("mean") / F.col("std")), "skew": F.when(~flat, F.col("skew")),
                          "kurt": F.when(~flat, F.col("kurt")), "std": F.when(~flat, F.col("std")).otherwise(F.lit(0.0))})


def _variance_term(sr: Column, skew: Column, kurt: Column) -> Column:
    return F.lit(1.0) - skew * sr + (kurt - 1) / F.lit(4.0) * sr * sr


def psr(sr: Column, n: Column, skew: Column, kurt: Column, sr_star: Column | float = 0.0) -> Column:
    """Probability that the true Sharpe ratio exceeds `sr_star`."""
    bar = sr_star if isinstance(sr_star, Column) else F.lit(float(sr_star))
    v = _variance_term(sr, skew, kurt)
    return F.when((v > 0) & (n >= 2) & sr.isNotNull(), norm_cdf((sr - bar) * F.sqrt(n - 1) / F.sqrt(v)))


def expected_max_sr(var_sr: Column, n_trials: Column) -> Column:
    """Expected best Sharpe ratio among independent trials without skill."""
    hi = norm_ppf(F.lit(1.0) - F.lit(1.0) / n_trials)
    lo = norm_ppf(F.lit(1.0) - F.lit(1.0) / (n_trials * F.lit(math.e)))
    value = F.sqrt(var_sr) * (F.lit(1 - EULER_GAMMA) * hi + F.lit(EULER_GAMMA) * lo)
    return F.when((n_trials > 1) & (var_sr > 0), value).otherwise(F.lit(0.0))


def dsr(sr: Column, n: Column, skew: Column, kurt: Column, var_sr: Column, n_trials: Column) -> Column:
    return psr(sr, n, skew, kurt, expected_max_sr(var_sr, n_trials))


def min_track_record(sr: Column, skew: Column, kurt: Column, sr_star: float = 0.0, confidence: float = 0.95) -> Column:
    from statistics import NormalDist

    z = NormalDist().inv_cdf(confidence)
    ratio = F.lit(z) / (sr - F.lit(sr_star))
    return F.when(sr > sr_star, F.lit(1.0) + _variance_term(sr, skew, kurt) * ratio * ratio).otherwise(F.lit(float("inf")))


def mean_pairwise_correlation(skill: DataFrame, day: str = "day", trial: str = "trial", value: str = "value") -> DataFrame:
    """Average correlation over trial pairs, and M.

    From sums only: with standardised series z_i, sum over i<>j of corr(z_i, z_j) = (sum_t (sum_i z_it)^2 - M (T-1)) / (T-1).
    No pairs are formed.
    """
    st = skill.groupBy(trial).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = skill.join(st, trial).withColumn("_z", (F.col(value) - F.col("_m")) / F.col("_s"))
    per_day = z.groupBy(day).agg(F.sum("_z").alias("_sz"), F.count("_z").alias("_k"))
    tot = per_day.agg(F.sum(F.col("_sz") * F.col("_sz")).alias("_q"), F.max("_k").cast("double").alias("n_trials"),
                      F.count(F.lit(1)).cast("double").alias("_t"))
    m, t = F.col("n_trials"), F.col("_t")
    rho = F.when(m >= 2, (F.col("_q") / (t - 1) - m) / (m * (m - 1)))
    return tot.select("n_trials", rho.alias("rho"))


def implied_trials(rho: Column, m: Column) -> Column:
    return F.coalesce(rho + (F.lit(1.0) - rho) * m, m)


def complete_days(losses: DataFrame, day: str, trial: str, value: str) -> DataFrame:
    """Rows of the days on which every trial has a loss."""
    n = losses.filter(F.col(value).isNotNull()).select(trial).distinct().count()
    full = losses.filter(F.col(value).isNotNull()).groupBy(day).agg(F.count_distinct(trial).alias("_k")).filter(F.col("_k") == n)
    return losses.join(full.select(day), day, "left_semi")


def skill_matrix(losses: DataFrame, benchmark: str, day: str = "day", trial: str = "trial", value: str = "loss") -> DataFrame:
    """(day, trial, value): benchmark loss minus trial loss, on complete days only."""
    whole = complete_days(losses, day, trial, value)
    base = whole.filter(F.col(trial) == benchmark).select(day, F.col(value).alias("_b"))
    return whole.join(base, day).select(day, trial, (F.col("_b") - F.col(value)).alias("value"))


def cscv_table(skill: DataFrame, blocks: int = 16, day: str = "day", trial: str = "trial", value: str = "value",
               stat: str = "mean") -> DataFrame:
    """One row per half split: best in-sample trial, its in- and out-of-sample value, rank and logit.

    The splits are the bit masks with half of their bits set.  The trials-by-blocks sums are one row; ranges of masks are dealt over tasks, and a task sums
    both halves of all its splits for all trials as one matrix product, so neither splits nor trials are shuffled.
    """
    if blocks % 2:
        raise ValueError("blocks must be even")
    pos = position_index(skill, day, "_t")
    n_days = pos.count()
    size = n_days // blocks
    block = F.floor((F.col("_t") - (n_days - size * blocks)) / size)
    sums = (skill.join(pos, day).withColumn("_blk", block).filter("_blk >= 0")
            .groupBy(trial, "_blk").agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q")))
    by_trial = sums.groupBy(F.col(trial).alias("trial")).agg(F.sort_array(F.collect_list(F.struct("_blk", "_s", "_q"))).alias("_a"))
    matrix = by_trial.agg(F.sort_array(F.collect_list(F.struct("trial", "_a"))).alias("_m")).select(
        F.col("_m.trial").alias("names"), F.flatten(F.transform("_m", lambda m: m["_a"]["_s"])).alias("s"), F.flatten(F.transform("_m", lambda m: m["_a"]["_q"])).alias("q"))
    step, k = max(1, (1 << blocks) // 64), float(size * (blocks // 2))

    def evaluate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for low, names, s, q in zip(batch.column("low").to_pylist(), *(batch.column(c) for c in ("names", "s", "q")), strict=True):
                masks = np.arange(low, min(low + step, 1 << blocks))
                masks = masks[np.bitwise_count(masks) == blocks // 2]
                if not len(masks) or not len(names.values):
                    continue
                inside = ((masks[:, None] >> np.arange(blocks)) & 1).astype(float)
                total, square = (x.values.to_numpy().reshape(-1, blocks).T for x in (s, q))

                def result(half: np.ndarray, total=total, square=square) -> np.ndarray:
                    t = half @ total
                    if stat == "mean":
                        return t / k
                    var = (half @ square - t * t / k) / (k - 1)
                    return t / k / np.sqrt(np.maximum(var, 1e-300))

                first, second = result(inside), result(1 - inside)
                best = np.round(first, 12).argmax(1)                     # of equal trials the first by name
                rows = np.arange(len(masks))
                mine = second[rows, best]
                rank = (np.round(second, 12) < np.round(mine, 12)[:, None]).sum(1) + 1
                yield pa.RecordBatch.from_arrays([pa.array(masks), names.values.take(pa.array(best)), pa.array(first[rows, best]), pa.array(mine), pa.array(rank.astype(np.int32)),
                                                  pa.array(np.full(len(masks), second.shape[1], np.int32)), pa.array(list(second), pa.list_(pa.float64()))],
                                                 ["combo", "trial", "is_best", "oos_best", "rank", "n_trials", "oos_all"])

    ranges = skill.sparkSession.range(0, 1 << blocks, step).withColumnRenamed("id", "low").repartition(min(64, 2 * skill.sparkSession.sparkContext.defaultParallelism))
    kind = dict(skill.dtypes)[trial]
    out = ranges.join(matrix).mapInArrow(evaluate, f"combo bigint, trial {kind}, is_best double, oos_best double, rank int, n_trials int, oos_all array<double>")
    omega = F.col("rank") / (F.col("n_trials") + 1)
    return out.withColumn("logit", F.ln(omega / (F.lit(1.0) - omega)))


def pbo(skill: DataFrame, blocks: int = 16, stat: str = "mean", **kw) -> DataFrame:
    """Probability of backtest overfitting and its companions, one row."""
    t = cut_lineage(cscv_table(skill, blocks, stat=stat, **kw))
    grid = [0.05 * i for i in range(1, 20)]
    probs = F.array(*[F.lit(g) for g in grid])
    head = t.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.median("logit").alias("logit_median"),
                 F.max("n_trials").alias("n_trials"), F.count(F.lit(1)).alias("combinations"),
                 F.regr_slope("oos_best", "is_best").alias("degradation_slope"), F.regr_intercept("oos_best", "is_best").alias("degradation_intercept"),
                 F.avg((F.col("oos_best") < 0).cast("double")).alias("prob_oos_loss"), F.median("oos_best").alias("oos_selected_median"),
                 F.percentile("oos_best", probs).alias("_sel"))
    every = t.select(F.explode("oos_all").alias("_o")).agg(F.percentile("_o", probs).alias("_every"))
    wins = F.size(F.filter(F.zip_with("_sel", "_every", lambda a, b: a >= b), lambda x: x))
    return head.join(every).withColumn("fsd_share", wins / F.lit(float(len(grid)))).drop("_sel", "_every")


def spa_test(skill: DataFrame, draws: int = 2000, mean_block: float = 10.0, seed: int = 0, day: str = "day", trial: str = "trial",
             value: str = "value", uniform: Uniform | None = None) -> DataFrame:
    """Superior predictive ability (three recentrings) and reality check, one row.

    A block of draws is an array of observation counts; the bootstrap means of all trials over it are one matrix product.
    """
    spark = skill.sparkSession
    pos = position_index(skill, day, "t")
    n = pos.count()
    rows = skill.join(pos, day).select("t", trial, value)
    counts = drawn_counts(spark, n, draws, mean_block, seed=seed, uniform=uniform)
    boot = cut_lineage(resampled_sums(rows, [trial], "t", [value], counts, n).select("b", trial, (F.col(value) / n).alias("_bm")))
    obs = rows.groupBy(trial).agg(F.avg(value).alias("_d"))
    spread = boot.groupBy(trial).agg(F.sqrt(F.lit(float(n)) * F.var_pop("_bm")).alias("_w"))
    root = math.sqrt(n)
    stats = obs.join(spread, trial).withColumn("_w", F.when(F.col("_w") > 0, F.col("_w")))
    floor = -F.sqrt(F.col("_w") * F.col("_w") / n * F.lit(2 * math.log(math.log(n))))
    stats = stats.withColumns({"_t": root * F.col("_d") / F.col("_w"), "_mu_lower": F.least(F.col("_d"), F.lit(0.0)),
                               "_mu_consistent": F.when(F.col("_d") >= floor, 0.0).otherwise(F.col("_d")), "_mu_upper": F.lit(0.0)})
    seen = stats.agg(F.greatest(F.max("_t"), F.lit(0.0)).alias("spa_stat"), (root * F.max("_d")).alias("_rc"), F.count(F.lit(1)).alias("models"))
    j = boot.join(stats, trial)
    centred = F.col("_bm") - F.col("_d")
    per_draw = j.groupBy("b").agg(*[F.greatest(F.max(root * (centred + F.col(f"_mu_{k}")) / F.col("_w")), F.lit(0.0)).alias(k)
                                    for k in ("lower", "consistent", "upper")], F.max(root * centred).alias("rc"))
    p = per_draw.join(seen).agg(*[F.avg((F.col(k) >= F.col("spa_stat")).cast("double")).alias(f"p_spa_{k}") for k in ("lower", "consistent", "upper")],
                                F.avg((F.col("rc") >= F.col("_rc")).cast("double")).alias("p_reality_check"), F.first("spa_stat").alias("spa_stat"),
                                F.first("models").alias("models"))
    return p.withColumns({"days": F.lit(n), "bootstrap": F.lit(draws), "mean_block": F.lit(mean_block)})


def holm(df: DataFrame, by: list[str], p: str, tie: str, out: str = "p_holm") -> DataFrame:
    """Step-down adjustment.  One row per trial, so the window is small."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = part.orderBy(p, tie)
    i, m = F.row_number().over(order), F.count(p).over(part)
    raw = df.withColumn("_a", F.least(F.lit(1.0), (m - i + 1) * F.col(p)))
    return raw.withColumn(out, F.max("_a").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_a")


def bhy(df: DataFrame, by: list[str], p: str, tie: str, out: str = "p_bhy") -> DataFrame:
    """False-discovery-rate adjustment valid under any dependence (harmonic constant, running minimum from the top)."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    up = part.orderBy(p, tie)
    i, m = F.row_number().over(up), F.count(p).over(part)
    raw = df.withColumn("_m", m).withColumn("_i", i).withColumn("_c", F.aggregate(
        F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k))
    raw = raw.withColumn("_a", F.least(F.lit(1.0), F.col(p) * F.col("_m") * F.col("_c") / F.col("_i")))
    return raw.withColumn(out, F.min("_a").over(up.rowsBetween(0, Window.unboundedFollowing))).drop("_a", "_m", "_i", "_c")
