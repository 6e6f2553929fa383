"""Virtual trading: positions, P&L, strategy statistics, forward record."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline import settings as S
from wattline.functions import quantiles as Q
from wattline.functions.clock import issue_time
from wattline.operators.ordered import top_per_group
from wattline.operators.reshape import markets_wide, running
from wattline.operators.resampling import bootstrap_mean_p
from wattline.plans.folds import Fold, assign_test_fold, spread_history
from wattline.settings import TRADE_COST

ROW = ["delivery_date", "ts_utc", "zone", "hour_local"]


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def net_pnl(x: Column, spread: Column, cost: float = TRADE_COST) -> Column:
    return x * spread - F.lit(cost) * F.abs(x)


def signal_wide(long: DataFrame, zones: list[str] | None = None) -> DataFrame:
    """mean, q05, q95, y per market side by side (suffix _da / _rt)."""
    d = long if zones is None else long.filter(F.col("zone").isin(zones))
    return markets_wide(d, ROW, ["mean", "q05", "q95", "y"], prefix=False, required=["mean_da", "mean_rt", "y_da", "y_rt"])


def positions_v1(w: DataFrame, lags: DataFrame, cost: float = TRADE_COST) -> DataFrame:
    """Signal rule (clipped standardised spread outside the cost band), persistence sign and always-short."""
    s = F.col("mean_da") - F.col("mean_rt")
    sd = lambda m: (F.col(f"q95_{m}") - F.col(f"q05_{m}")) / F.lit(3.29)                    # noqa: E731
    scale = F.sqrt(sd("da") * sd("da") + sd("rt") * sd("rt"))
    x = F.when(F.abs(s) > cost, F.coalesce(clamp(F.try_divide(s, scale)), F.lit(0.0))).otherwise(F.lit(0.0))
    j = w.withColumn("x_signal", x).join(lags, ["ts_utc", "zone"], "left")
    j = j.withColumns({"x_persistence": F.coalesce(F.signum(F.col("lag_da_d1_total") - F.col("lag_rt_d2_total")), F.lit(0.0)), "x_always_dec": F.lit(-1.0),
                       "spread": F.col("y_da") - F.col("y_rt")})
    return j.withColumns({f"pnl_{k}": net_pnl(F.col(f"x_{k}"), F.col("spread"), cost) for k in ("signal", "persistence", "always_dec")})


def distribution_wide(long: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Trimmed mean and scale of the quantile row, per market side by side."""
    d = long.withColumns({"dmean": Q.distribution_mean(), "sd": Q.distribution_scale()})
    return markets_wide(d, keys, values, prefix=False, required=[])


def position_v2(da: Column, rt: Column, sd_da: Column, sd_rt: Column, rho: Column, cost: float = TRADE_COST) -> tuple[Column, Column, Column]:
    """(spread, correlated scale, MW)."""
    s = da - rt
    var = F.greatest(sd_da * sd_da + sd_rt * sd_rt - F.lit(2.0) * rho * sd_da * sd_rt, F.lit(1e-6))
    scale = F.sqrt(var)
    return s, scale, F.when(F.abs(s) > cost, clamp(s / scale)).otherwise(F.lit(0.0))


def fold_rho(resid: DataFrame, folds: list[Fold], lookback_days: int = 365) -> DataFrame:
    """(fold, zone, rho): correlation of da and rt residuals over the year before each training end."""
    return spread_history(resid, folds, lookback_days).groupBy("fold", "zone").agg(F.corr("r_da", "r_rt").alias("rho"))


def positions_v2(long: DataFrame, spike: DataFrame, lags: DataFrame, folds: list[Fold], zones: list[str] | None = None,
                 cost: float = TRADE_COST) -> DataFrame:
    """Distribution means, spike-mixed real time and month-wise residual correlation; with the v1 columns for comparison."""
    d = long if zones is None else long.filter(F.col("zone").isin(zones))
    w = distribution_wide(d, ["mean", "dmean", "sd", "y", "q05", "q95"], ROW).dropna(subset=["dmean_da", "dmean_rt", "y_da", "y_rt"])
    w = w.join(spike.select("ts_utc", "zone", "p_spike", "spike_mean"), ["ts_utc", "zone"], "left")
    w = w.withColumns({"m_rt": Q.mixture_mean(F.col("dmean_rt"), F.col("spike_mean"), F.col("p_spike")), "r_da": F.col("y_da") - F.col("mean_da"),
                       "r_rt": F.col("y_rt") - F.col("mean_rt")})
    rho = fold_rho(w.select("delivery_date", "zone", "r_da", "r_rt"), folds)
    w = assign_test_fold(w, folds).drop("train_end").join(rho, ["fold", "zone"], "left").withColumn("rho", F.coalesce(F.nanvl("rho", F.lit(0.0)), F.lit(0.0)))
    _, _, x = position_v2(F.col("dmean_da"), F.col("m_rt"), F.col("sd_da"), F.col("sd_rt"), F.col("rho"), cost)
    w = w.withColumn("x_signal_v2", x).withColumn("pnl_signal_v2", net_pnl(F.col("x_signal_v2"), F.col("y_da") - F.col("y_rt"), cost))
    v1 = positions_v1(w.select(*ROW, "mean_da", "mean_rt", "q05_da", "q95_da", "q05_rt", "q95_rt", "y_da", "y_rt"), lags, cost)
    return w.withColumn("spread", F.col("y_da") - F.col("y_rt")).join(
        v1.select("ts_utc", "zone", "x_signal", "pnl_signal", "x_persistence", "pnl_persistence"), ["ts_utc", "zone"])


def live_positions(forecast: DataFrame, spike: DataFrame, resid: DataFrame, fold: Fold, zones: list[str] | None = None,
                   cost: float = TRADE_COST) -> DataFrame:
    """Rule v2 for one delivery day; rho from residuals known at the fold's training end."""
    d = forecast if zones is None else forecast.filter(F.col("zone").isin(zones))
    w = distribution_wide(d, ["dmean", "sd"], ["issue_utc", *ROW]).join(spike.select("ts_utc", "zone", "p_spike", "spike_mean"), ["ts_utc", "zone"], "left")
    rho = fold_rho(resid, [fold]).drop("fold")
    w = w.join(rho, "zone", "left").withColumn("rho", F.coalesce(F.nanvl("rho", F.lit(0.0)), F.lit(0.0)))
    m_rt = Q.mixture_mean(F.col("dmean_rt"), F.col("spike_mean"), F.col("p_spike"))
    s, scale, x = position_v2(F.col("dmean_da"), m_rt, F.col("sd_da"), F.col("sd_rt"), F.col("rho"), cost)
    return w.select("issue_utc", *ROW, s.alias("spread_fcst"), scale.alias("spread_scale"), "rho", "p_spike", x.alias("x_mw"))


def naive_last_spread(w: DataFrame) -> DataFrame:
    """Sign of the same location's spread 48 hours earlier."""
    lag = w.select("zone", (F.col("ts_utc") + F.expr("INTERVAL 48 HOUR")).alias("ts_utc"), (F.col("y_da") - F.col("y_rt")).alias("_lag"))
    return w.join(lag, ["zone", "ts_utc"], "left").withColumn("x_naive", F.coalesce(F.signum("_lag"), F.lit(0.0))).drop("_lag")


def melt_strategies(w: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"x_{n}").cast("double").alias("x"), F.col(f"pnl_{n}").cast("double").alias("pnl")) for n in names])
    return w.select(*keep, F.explode(rows).alias("_r")).select(*keep, "_r.*")


def strategy_stats(trades: DataFrame, by: list[str], exclude: list[date] | None = None) -> DataFrame:
    """Totals, hit rate, annualised Sharpe, drawdown and concentration per strategy.

    Trades collapse to a daily series first; ordered steps only see one row per day.
    """
    row = trades.groupBy(*by).agg(F.sum(F.abs("x")).alias("mwh_traded"),
                                  F.avg(F.when(F.col("x") != 0, (F.col("pnl") > 0).cast("double"))).alias("hit_rate"))
    daily = trades.groupBy(*by, "delivery_date").agg(F.sum("pnl").alias("pnl"))
    path = running(daily, by, "delivery_date", "pnl", "cum")
    out = F.col("delivery_date").isin(exclude) if exclude else F.lit(False)
    base = path.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.sum("pnl").alias("pnl_total"), F.avg("pnl").alias("_m"), F.stddev_samp("pnl").alias("_s"),
                                 F.min("cum_drawdown").alias("max_drawdown"), F.sum(F.when(~out, F.col("pnl"))).alias("pnl_excluding"))
    n = daily.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))))
    ranked = n.withColumn("_r", F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc(F.abs("pnl")), "delivery_date")))
    top = ranked.filter(F.col("_r") <= F.greatest(F.floor(F.col("_n") / 100), F.lit(1))).groupBy(*by).agg(F.sum("pnl").alias("_top"))
    j = (base.join(row, by).join(top, by) if by else base.join(row).join(top))
    return j.select(*by, "days", "pnl_total", F.try_divide("pnl_total", "mwh_traded").alias("pnl_per_mwh"), "mwh_traded", "hit_rate",
                    F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(F.lit(365.0))).alias("sharpe_ann"), "max_drawdown", "pnl_excluding",
                    F.try_divide("_top", "pnl_total").alias("top1pct_days_share"))


def paper_pnl(positions: DataFrame, outcomes: DataFrame, cost: float = TRADE_COST) -> DataFrame:
    """Daily and cumulative P&L of settled positions."""
    j = positions.join(outcomes.filter("y_da IS NOT NULL AND y_rt IS NOT NULL"), ["ts_utc", "zone"])
    g = j.groupBy("delivery_date").agg(F.sum(F.abs("x_mw")).alias("mwh"), F.sum("x_mw").alias("net_mw"),
                                       F.sum(net_pnl(F.col("x_mw"), F.col("y_da") - F.col("y_rt"), cost)).alias("pnl"))
    return running(g, [], "delivery_date", "pnl", "cum_pnl").drop("cum_pnl_drawdown")


def counted_days(positions: DataFrame, outcomes: DataFrame, start: date, min_rows: int = 11 * 23) -> DataFrame:
    """Positions that count: made by the bid deadline, on days that are complete and fully settled."""
    x = positions.filter((F.col("delivery_date") >= F.lit(start)) & (F.col("created_utc") <= issue_time(F.col("delivery_date"))))
    j = x.join(outcomes, ["ts_utc", "zone"], "left")
    ok = j.groupBy("delivery_date").agg(F.count(F.lit(1)).alias("_n"), F.count("y_da").alias("_a"), F.count("y_rt").alias("_b")).filter(
        (F.col("_n") >= min_rows) & (F.col("_a") == F.col("_n")) & (F.col("_b") == F.col("_n")))
    return j.join(ok.select("delivery_date"), "delivery_date", "left_semi")


def forward_state(daily: DataFrame, start: date, today: date, n: int = 365, min_coverage: float = 0.8, draws: int = 10_000) -> DataFrame:
    """waiting / invalid / scored.  No test is computed before n counted days; then one test on the first n days."""
    first = top_per_group(daily.withColumn("_g", F.lit(0)), ["_g"], [F.asc("delivery_date")], n, "_r").drop("_g", "_r")
    agg = first.agg(F.count(F.lit(1)).alias("n_days"), F.sum("pnl").alias("total"), F.avg("pnl").alias("mean_daily"), F.min("delivery_date").alias("first_day"),
                    F.max("delivery_date").alias("last_day"))
    have = first.count()
    open_span = F.greatest(F.lit((today - start).days + 1), F.col("n_days"), F.lit(1))
    done_span = F.datediff("last_day", F.lit(start)) + 1
    if have < n:
        return agg.select(F.lit("waiting").alias("status"), "n_days", (F.col("n_days") / open_span).alias("coverage"), F.coalesce("total", F.lit(0.0)).alias("total"))
    test = bootstrap_mean_p(first, [], "delivery_date", "pnl", draws)
    j = agg.join(test.select("t_stat", "p_value"))
    cov = F.lit(float(n)) / done_span
    ok = cov >= min_coverage
    verdict = F.when((F.col("p_value") < 0.05) & (F.col("mean_daily") > 0), "forward pass (p < 0.05)").otherwise("not shown (underpowered: not evidence of no edge)")
    return j.select(F.when(ok, "scored").otherwise("invalid").alias("status"), "n_days", cov.alias("coverage"), *[
        F.when(ok, c).alias(a) for a, c in (("first_day", F.col("first_day")), ("last_day", F.col("last_day")), ("mean_daily", F.col("mean_daily")),
                                            ("total", F.col("total")), ("t_stat", F.col("t_stat")), ("p_value", F.col("p_value")), ("verdict", verdict))])


def residual_history(runs: list[DataFrame], live: DataFrame | None, outcomes: DataFrame) -> DataFrame:
    """Residuals of the stored runs (later runs win), then live days after the last stored hour."""
    from wattline.operators.reshape import latest_union

    stored = latest_union([r.filter("component = 'total'").select("delivery_date", "ts_utc", "zone", "market", "mean", "y") for r in runs], ["ts_utc", "zone", "market"])
    w = markets_wide(stored, ["delivery_date", "ts_utc", "zone"], ["mean", "y"], prefix=False, required=[])
    if live is not None:
        last = w.agg(F.max("ts_utc").alias("_last"))
        lw = markets_wide(live.filter("component = 'total'"), ["delivery_date", "ts_utc", "zone"], ["mean"], prefix=False, required=[])
        lw = lw.join(outcomes, ["ts_utc", "zone"], "left").join(last).filter(F.col("ts_utc") > F.col("_last")).drop("_last")
        w = w.unionByName(lw, allowMissingColumns=True)
    w = w.dropna(subset=["mean_da", "mean_rt", "y_da", "y_rt"])
    return w.withColumns({"r_da": F.col("y_da") - F.col("mean_da"), "r_rt": F.col("y_rt") - F.col("mean_rt")})


def cost_table(trades: DataFrame, by: list[str], costs: tuple = (0.25, 0.5, 1.0), base: float = S.TRADE_COST) -> DataFrame:
    """Net P&L at other cost levels: only the cost term changes."""
    return trades.groupBy(*by).agg(*[F.sum(F.col("pnl") + F.lit(base - c) * F.abs("x")).alias(f"cost_{round(c * 100):03d}") for c in costs])


def skill_table(trades: DataFrame, by: list[str]) -> DataFrame:
    """Realised spread when long and short, and the correlation of signed size with it (`spread` column required)."""
    return trades.groupBy(*by).agg(F.avg(F.when(F.col("x") > 0, F.col("spread"))).alias("mean_spread_when_inc"),
                                   F.avg(F.when(F.col("x") < 0, F.col("spread"))).alias("mean_spread_when_dec"), F.corr("x", "spread").alias("corr_signed_mw_spread"))


def period_table(trades: DataFrame, by: list[str], edges: list[date]) -> DataFrame:
    """P&L per declared period between the edges."""
    slot = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("delivery_date").cast("date")))
    return trades.groupBy(*by, slot.alias("period")).agg(F.sum("pnl").alias("pnl"))
