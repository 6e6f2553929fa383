"""Read side: the questions a dashboard asks, as DataFrames over the stored tables.

Ranges are filters on the raw time column, so they prune the scan.  A date of None means the latest one stored.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.clock import day_bounds
from wattline.functions.numeric import tidy_value
from wattline.operators.reshape import pivot_values, running, time_by_node
from wattline.operators.timeweight import lookback_filter, time_weighted
from wattline.plans.trading import net_pnl
from wattline.settings import FUELS, SYSTEM_ZONE, TRADE_COST


def tidy(df: DataFrame) -> DataFrame:
    """Doubles without NaN, rounded to cents."""
    return df.withColumns({c: tidy_value(F.col(c)) for c, t in df.dtypes if t == "double"})


def on_day(df: DataFrame, day: date, ts: str = "ts_utc") -> DataFrame:
    lo, hi = day_bounds(day)
    return df.filter((F.col(ts) >= lo) & (F.col(ts) < hi))


def at_latest(df: DataFrame, column: str, value=None) -> DataFrame:
    """Rows at `value`, or at the largest value of `column` (a one-row aggregate joined back)."""
    if value is not None:
        return df.filter(F.col(column) == F.lit(value))
    return df.join(df.agg(F.max(column).alias(column)), column, "left_semi")


def day_summary(system_5m: DataFrame, daily_summary: DataFrame, day: date) -> dict[str, DataFrame]:
    return {"daily": tidy(daily_summary.filter(F.col("day") == F.lit(day))),
            "series": tidy(on_day(system_5m, day).select("ts_utc", "ts_local", "load_mw", "net_load_mw", "rt_lbmp").orderBy("ts_utc"))}


def fuel_series(fuel_5m: DataFrame, btm_solar: DataFrame, day: date, system: str = SYSTEM_ZONE, fuels: list[str] = FUELS) -> DataFrame:
    """One column per fuel on the 5-minute grid; hourly solar is held over its hour."""
    grid = pivot_values(on_day(fuel_5m, day), ["ts_utc"], "fuel", fuels, "gen_mw")
    solar = on_day(btm_solar.filter(F.col("zone") == system), day).groupBy(F.date_trunc("hour", "ts_utc").alias("_h")).agg(F.max_by("mw", "ts_utc").alias("BTM Solar"))
    return tidy(grid.join(solar, F.date_trunc("hour", "ts_utc") == F.col("_h"), "left").drop("_h").orderBy("ts_utc"))


def zone_prices(hourly: DataFrame, price_5m: DataFrame, day: date) -> dict[str, DataFrame]:
    cols = ["ts_utc", "zone", "da_lbmp", "rt_lbmp", "da_rt_spread", "da_mcc", "rt_mcc"]
    return {"hourly": tidy(on_day(hourly, day).select(*cols).orderBy("ts_utc", "zone")), "rt5": tidy(on_day(price_5m, day).select("ts_utc", "zone", "lbmp").orderBy("ts_utc", "zone"))}


def node_price_matrix(rt_nodes: DataFrame, rt_hourly: DataFrame, da_nodes: DataFrame, day: date, market: str = "rt5") -> tuple[str, DataFrame]:
    """(market used, one row per time with a node -> price map).  An empty 5-minute day falls back to hourly real time."""
    lo, hi = day_bounds(day)
    if market == "rt5":
        rows = time_weighted(rt_nodes.filter(lookback_filter(F.col("ts_utc"), lo, hi)), ["ptid"], ["lbmp"])
        rows = on_day(rows, day)
        if rows.isEmpty():
            market = "rt"
    if market != "rt5":
        if market not in ("rt", "da"):
            raise ValueError(market)
        rows = on_day(rt_hourly if market == "rt" else da_nodes, day)
    return market, time_by_node(rows, "ts_utc", "ptid", "lbmp").orderBy("ts_utc")


def constraint_list(constraints_daily: DataFrame, day: date) -> DataFrame:
    d = constraints_daily.filter(F.col("day") == F.lit(day))
    return d.orderBy(F.desc(F.abs("sum_cost")), "market", "facility", "contingency")


def interface_flows(flows_hourly: DataFrame, day: date) -> DataFrame:
    return tidy(on_day(flows_hourly, day).orderBy("interface", "ts_utc"))


def trends(table: DataFrame, start: date, end: date) -> DataFrame:
    return tidy(table.filter(F.col("day").between(F.lit(start), F.lit(end))))


def mappable_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("lat IS NOT NULL AND lon IS NOT NULL AND has_prices").select("ptid", "name", "zone", "subzone", "lat", "lon")


# ------------------------------------------------------------------------------------------ structure


def signal_folds(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("fold").distinct()


def signal_constraints(catalogue: DataFrame, zone_factors: DataFrame, market: str = "da", fold: str | None = None) -> DataFrame:
    """Catalogue with each constraint's most sensitive zone (largest |factor|, ties by name)."""
    c = at_latest(catalogue.filter(F.col("market") == market), "fold", fold)
    best = zone_factors.groupBy("fold", "market", "key").agg(F.max_by("zone", F.struct(F.abs("a"), "zone")).alias("most_sensitive_zone"))
    return c.join(best, ["fold", "market", "key"], "left").select("fold", "rank", "key", "sum_abs_shadow", "bind_rate", "most_sensitive_zone")


def signal_node_factors(node_factors: DataFrame, node_meta: DataFrame, node_fit: DataFrame, key: str, market: str = "da", fold: str | None = None) -> DataFrame:
    n = at_latest(node_factors.filter(F.col("market") == market), "fold", fold).filter(F.col("key") == key)
    return n.join(node_meta.filter("lat IS NOT NULL"), "ptid").join(node_fit, ["ptid", "market", "fold"], "left").select(
        "ptid", "name", "zone", "lat", "lon", "a", "r2_in_window")


def signal_cobinding(cobinding: DataFrame, market: str = "da", fold: str | None = None, top: int = 80) -> DataFrame:
    e = at_latest(cobinding.filter(F.col("market") == market), "fold", fold)
    return e.orderBy(F.desc("jaccard"), "key_a", "key_b").limit(top).select("key_a", "key_b", "hours_both", "jaccard")


def signal_forecast(pred: DataFrame, run_id: str, zone: str, day: date, market: str = "da", component: str = "total") -> DataFrame:
    hit = (F.col("run_id") == run_id) & (F.col("zone") == zone) & (F.col("delivery_date") == F.lit(day)) & (F.col("market") == market) & (F.col("component") == component)
    return pred.filter(hit).orderBy("ts_utc")


# ------------------------------------------------------------------------------------------ live


def live_dates(live_forecasts: DataFrame) -> DataFrame:
    return live_forecasts.groupBy("delivery_date", "signal").agg(F.max("created_utc").alias("created"))


def _actual(component: str = "total"):
    pick = {"total": ("da_lbmp", "rt_lbmp", 1), "congestion": ("da_mcc", "rt_mcc", -1)}[component]
    return F.when(F.col("market") == "da", F.col(pick[0])).otherwise(F.col(pick[1])) * F.lit(pick[2])


def live_forecast(live_forecasts: DataFrame, hourly: DataFrame, zone: str, day: date | None = None, component: str = "total") -> DataFrame:
    f = at_latest(live_forecasts, "delivery_date", day).filter((F.col("zone") == zone) & (F.col("component") == component))
    j = f.join(hourly.select("zone", "ts_utc", "da_lbmp", "rt_lbmp", "da_mcc", "rt_mcc"), ["zone", "ts_utc"], "left")
    return j.select("market", "ts_utc", "hour_local", "mean", "q05", "q25", "q50", "q75", "q95", _actual(component).alias("actual"), "issue_utc").orderBy("market", "ts_utc")


def live_track(live_forecasts: DataFrame, hourly: DataFrame, since: date) -> DataFrame:
    """MAE and 90 % coverage per day and market of the live total forecast."""
    f = live_forecasts.filter((F.col("component") == "total") & (F.col("delivery_date") >= F.lit(since)))
    j = f.join(hourly.select("zone", "ts_utc", "da_lbmp", "rt_lbmp"), ["zone", "ts_utc"]).withColumn("_y", _actual()).filter("_y IS NOT NULL")
    inside = F.when(F.col("_y").between(F.col("q05"), F.col("q95")), 1.0).otherwise(0.0)
    return j.groupBy("delivery_date", "market").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("mean") - F.col("_y"))).alias("mae"), F.avg(inside).alias("cov90"))


def live_nodes(node_forecasts: DataFrame, nodes: DataFrame, market: str = "da", day: date | None = None) -> DataFrame:
    n = at_latest(node_forecasts, "delivery_date", day).filter(F.col("market") == market)
    j = n.join(nodes.filter("lat IS NOT NULL").select("ptid", "name", "lat", "lon"), "ptid")
    return j.groupBy("ptid", "name", "zone", "lat", "lon").agg(F.avg("total").alias("total"), F.avg("congestion").alias("congestion"))


def live_positions(live_dart: DataFrame, hourly: DataFrame, day: date | None = None, cost: float = TRADE_COST) -> DataFrame:
    """Per zone: highest spike probability and its hour, volumes, spread, and P&L of the settled hours."""
    x = at_latest(live_dart, "delivery_date", day)
    j = x.join(hourly.select("zone", "ts_utc", "da_lbmp", "rt_lbmp"), ["zone", "ts_utc"], "left")
    spread = F.col("da_lbmp") - F.col("rt_lbmp")
    return j.groupBy("zone").agg(
        F.max("p_spike").alias("p_spike_max"), F.max_by("hour_local", F.struct("p_spike", -F.col("hour_local"))).alias("p_spike_hour"), F.sum("x_mw").alias("net_mwh"),
        F.sum(F.abs("x_mw")).alias("gross_mwh"), F.avg("spread_fcst").alias("spread_fcst"), F.avg(spread).alias("spread_actual"),
        F.sum(net_pnl(F.col("x_mw"), spread, cost)).alias("pnl"), F.count("rt_lbmp").alias("settled_hours"), F.count(F.lit(1)).alias("hours"))


def live_paper(live_dart: DataFrame, hourly: DataFrame, cost: float = TRADE_COST) -> DataFrame:
    """Daily and cumulative P&L over fully settled days."""
    j = live_dart.join(hourly.select("zone", "ts_utc", "da_lbmp", "rt_lbmp"), ["zone", "ts_utc"], "left")
    pnl = net_pnl(F.col("x_mw"), F.col("da_lbmp") - F.col("rt_lbmp"), cost)
    g = j.groupBy("delivery_date").agg(F.sum(F.abs("x_mw")).alias("mwh"), F.sum(pnl).alias("pnl"), F.count(pnl).alias("_k"), F.count(F.lit(1)).alias("_n")).filter("_k = _n")
    return running(g.drop("_k", "_n"), [], "delivery_date", "pnl", "cum_pnl").drop("cum_pnl_drawdown")


def live_monthly(table: DataFrame, zone: str) -> DataFrame:
    return at_latest(table, "cutoff").filter(F.col("zone") == zone).select("cutoff", "month", "h", "period", "component", "model", "mean", "q05", "q50", "q95")
