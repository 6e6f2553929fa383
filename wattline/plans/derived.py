"""The derived tables of the warehouse, each a function of curated DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.clock import local_date, to_local
from wattline.functions.numeric import weighted_mean
from wattline.operators.timeweight import HOUR, time_weighted
from wattline.settings import CARBON_FREE_FUELS, EXTERNAL_ZONES, MARKET_TZ, RENEWABLE_FUELS, SYSTEM_ZONE

MISMATCH = 0.02


def hour_of(ts: str = "ts_utc"):
    return F.date_trunc("hour", ts).alias("ts_utc")


def zone_prices_5m(rt_lbmp_zone: DataFrame) -> DataFrame:
    return time_weighted(rt_lbmp_zone, ["zone"], ["lbmp", "mlc", "mcc"])


def fuel_mix_5m(fuel_mix: DataFrame) -> DataFrame:
    return time_weighted(fuel_mix, ["fuel"], ["gen_mw"])


def load_zone_5m(load: DataFrame) -> DataFrame:
    return time_weighted(load, ["zone"], ["load_mw"], stamped="start")


def interface_flows_hourly(flows: DataFrame) -> DataFrame:
    return time_weighted(flows, ["interface"], ["flow_mw", "pos_limit_mw", "neg_limit_mw"], bucket=HOUR, stamped="start")


def with_system_total(zone_load: DataFrame, label: str = SYSTEM_ZONE) -> DataFrame:
    """Detail rows plus one total row per time; the total is only as covered as its least covered zone."""
    total = zone_load.groupBy("ts_utc").agg(F.sum("load_mw").alias("load_mw"), F.min("covered_s").alias("covered_s"))
    return zone_load.select("ts_utc", "zone", "load_mw", "covered_s").unionByName(total.withColumn("zone", F.lit(label)))


def system_5m(load_5m: DataFrame, fuel_5m: DataFrame, price_5m: DataFrame, label: str = SYSTEM_ZONE, external: list[str] = EXTERNAL_ZONES,
              wind: str = "Wind", tz: str = MARKET_TZ) -> DataFrame:
    """Total load, load net of wind, and the plain mean price of the internal zones."""
    base = load_5m.filter(F.col("zone") == label).select("ts_utc", "load_mw", "covered_s")
    blow = fuel_5m.filter(F.col("fuel") == wind).select("ts_utc", F.col("gen_mw").alias("_wind"))
    price = price_5m.filter(~F.col("zone").isin(external)).groupBy("ts_utc").agg(F.avg("lbmp").alias("rt_lbmp"))
    return base.join(blow, "ts_utc", "left").join(price, "ts_utc", "left").select(
        "ts_utc", to_local(F.col("ts_utc"), tz).alias("ts_local"), "load_mw", "covered_s",
        (F.col("load_mw") - F.col("_wind")).alias("net_load_mw"), "rt_lbmp")


def prefer_published(published: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Published rows, plus derived rows for the keys that have none."""
    return published.unionByName(derived.join(published.select(*keys), keys, "left_anti"))


def zone_prices_hourly(da: DataFrame, rt_hourly: DataFrame, price_5m: DataFrame, tz: str = MARKET_TZ) -> DataFrame:
    """Day-ahead and real-time hourly prices; real time is the published value, else the time-weighted one.

    `rt_flag` marks published values that disagree with their own 5-minute file.
    """
    fields = ["lbmp", "mlc", "mcc"]
    published = rt_hourly.select("ts_utc", "zone", *fields, F.lit("integrated").alias("rt_source"))
    derived = price_5m.groupBy(hour_of(), "zone").agg(*[weighted_mean(F.col(c), F.col("covered_s")).alias(c) for c in fields])
    rt = prefer_published(published, derived.withColumn("rt_source", F.lit("derived_twa")), ["ts_utc", "zone"])
    rt = rt.join(derived.select("ts_utc", "zone", F.col("lbmp").alias("_own")), ["ts_utc", "zone"], "left")
    flag = F.when((F.col("rt_source") == "integrated") & (F.abs(F.col("lbmp") - F.col("_own")) >= MISMATCH), F.lit("integrated_vs_5m_mismatch"))
    rt = rt.select("ts_utc", "zone", *[F.col(c).alias(f"rt_{c}") for c in fields], "rt_source", flag.alias("rt_flag"))
    day_ahead = da.select("ts_utc", "zone", *[F.col(c).alias(f"da_{c}") for c in fields])
    both = day_ahead.join(rt, ["ts_utc", "zone"], "full")
    return both.select("ts_utc", to_local(F.col("ts_utc"), tz).alias("ts_local"), "zone", "da_lbmp", "da_mlc", "da_mcc", "rt_lbmp",
                       "rt_mlc", "rt_mcc", "rt_source", "rt_flag", (F.col("da_lbmp") - F.col("rt_lbmp")).alias("da_rt_spread"))


def hourly_weighted(df: DataFrame, entity: str, value: str) -> DataFrame:
    return df.groupBy(hour_of(), entity).agg(weighted_mean(F.col(value), F.col("covered_s")).alias(value))


def day_ahead_load_forecast(load_forecast: DataFrame, tz: str = MARKET_TZ) -> DataFrame:
    """The vintage issued the day before the target's local day."""
    issued = F.col("issue_date") == F.date_sub(local_date(F.col("ts_utc"), tz), 1)
    return load_forecast.filter(issued).select("ts_utc", "zone", "load_forecast_mw")


def constraints_daily(da: DataFrame, rt: DataFrame) -> DataFrame:
    def roll(df: DataFrame, market: str, hours: float) -> DataFrame:
        return df.groupBy(F.to_date("ts_local").alias("day"), "facility", "contingency").agg(
            F.count(F.lit(1)).alias("intervals"), (F.count(F.lit(1)) * F.lit(hours)).alias("hours_binding"), F.sum("shadow_price").alias("sum_cost"),
            F.max(F.abs("shadow_price")).alias("max_abs_cost"), F.avg("shadow_price").alias("avg_cost")).withColumn("market", F.lit(market))
    return roll(da, "DA", 1.0).unionByName(roll(rt, "RT", 5 / 60))


def fuel_daily(fuel_5m: DataFrame, tz: str = MARKET_TZ) -> DataFrame:
    return fuel_5m.groupBy(local_date(F.col("ts_utc"), tz).alias("day"), "fuel").agg(
        weighted_mean(F.col("gen_mw"), F.col("covered_s")).alias("avg_mw"))


def fuel_mix_daily(fuel_5m: DataFrame, btm_solar: DataFrame, label: str = SYSTEM_ZONE, tz: str = MARKET_TZ) -> DataFrame:
    solar = btm_solar.filter(F.col("zone") == label).groupBy(F.to_date("ts_local").alias("day")).agg(F.avg("mw").alias("avg_mw"))
    return fuel_daily(fuel_5m, tz).unionByName(solar.withColumn("fuel", F.lit("BTM Solar")))


def daily_summary(system: DataFrame, hourly_prices: DataFrame, fuel_5m: DataFrame, external: list[str] = EXTERNAL_ZONES,
                  tz: str = MARKET_TZ) -> DataFrame:
    """Load, price and fuel indicators per local day; the main source breaks ties by name."""
    w = F.col("covered_s")
    s = system.groupBy(F.to_date("ts_local").alias("day")).agg(
        weighted_mean(F.col("load_mw"), w).alias("avg_load_mw"), F.max("load_mw").alias("peak_load_mw"),
        weighted_mean(F.col("net_load_mw"), w).alias("avg_net_load_mw"))
    p = hourly_prices.filter(~F.col("zone").isin(external)).groupBy(F.to_date("ts_local").alias("day")).agg(
        F.avg("da_lbmp").alias("avg_da_lbmp"), F.avg("rt_lbmp").alias("avg_rt_lbmp"))
    mw = F.col("avg_mw")
    share = lambda names: F.try_divide(F.sum(F.when(F.col("fuel").isin(names), mw)), F.sum(mw))     # noqa: E731
    f = fuel_daily(fuel_5m, tz).groupBy("day").agg(
        F.max_by("fuel", F.struct("avg_mw", "fuel")).alias("main_source"), F.sum(mw).alias("avg_gen_mw"),
        share(RENEWABLE_FUELS).alias("renewable_share"), share(CARBON_FREE_FUELS).alias("carbon_free_share"))
    return s.join(p, "day", "left").join(f, "day", "left")


def zone_prices_daily(hourly_prices: DataFrame) -> DataFrame:
    return hourly_prices.groupBy(F.to_date("ts_local").alias("day"), "zone").agg(
        F.avg("da_lbmp").alias("avg_da_lbmp"), F.avg("rt_lbmp").alias("avg_rt_lbmp"), F.avg("da_rt_spread").alias("avg_spread"))


def shadow_prices(da: DataFrame, rt: DataFrame) -> DataFrame:
    """(market, d, hr, key, mu): hourly shadow price per constraint; only non-zero rows.

    Day-ahead: duplicates of a stamp are summed, then the stamps of the hour averaged.  Real time: sum x 5/60.
    """
    from wattline.functions.names import constraint_key

    key = constraint_key(F.col("facility"), F.col("contingency")).alias("key")
    slot = [F.to_date("ts_local").alias("d"), F.hour("ts_local").alias("hr")]
    per_stamp = da.groupBy("ts_local", key).agg(F.sum("shadow_price").alias("_s"))
    a = per_stamp.groupBy(*slot, "key").agg(F.avg("_s").alias("mu")).withColumn("market", F.lit("da"))
    b = rt.groupBy(*slot, key).agg((F.sum("shadow_price") * F.lit(5.0) / F.lit(60.0)).alias("mu")).withColumn("market", F.lit("rt"))
    return a.unionByName(b).filter("mu <> 0").select("market", "d", "hr", "key", "mu")


def node_congestion(prices: DataFrame) -> DataFrame:
    """(d, hr, ptid, cong), long: a repeated autumn hour is averaged."""
    return prices.groupBy(F.to_date("ts_local").alias("d"), F.hour("ts_local").alias("hr"), "ptid").agg(F.avg(-F.col("mcc")).alias("cong"))


def point_congestion(zone_prices: DataFrame, node_prices: DataFrame) -> DataFrame:
    """(ts_utc, ptid, cong) over zones and nodes."""
    cols = ["ts_utc", "ptid", "mcc"]
    return zone_prices.select(*cols).unionByName(node_prices.select(*cols)).groupBy("ts_utc", "ptid").agg(F.avg(-F.col("mcc")).alias("cong"))


def priced_points(zone_prices: DataFrame, node_prices: DataFrame) -> DataFrame:
    """(ptid, kind): zone points, and node points that are not zones."""
    z = zone_prices.select("ptid").distinct()
    n = node_prices.select("ptid").distinct().join(z, "ptid", "left_anti")
    return z.withColumn("kind", F.lit("zone")).unionByName(n.withColumn("kind", F.lit("node")))


def build_all(curated: dict[str, DataFrame], label: str = SYSTEM_ZONE, tz: str = MARKET_TZ) -> dict[str, DataFrame]:
    """Every derived table from the curated ones.  Nothing runs until a table is written or read."""
    price5, fuel5 = zone_prices_5m(curated["rt_lbmp_zone"]), fuel_mix_5m(curated["fuel_mix"])
    zone5 = load_zone_5m(curated["load"])
    load5 = with_system_total(zone5, label)
    system = system_5m(load5, fuel5, price5, label, tz=tz)
    hourly = zone_prices_hourly(curated["da_lbmp_zone"], curated["rt_lbmp_zone_hourly"], price5, tz)
    return {
        "rt_lbmp_zone_5m": price5, "fuel_mix_5m": fuel5, "load_zone_5m": zone5, "load_5m": load5, "system_5m": system,
        "interface_flows_hourly": interface_flows_hourly(curated["interface_flows"]), "lbmp_zone_hourly": hourly,
        "fuel_mix_hourly": hourly_weighted(fuel5, "fuel", "gen_mw"), "load_hourly": hourly_weighted(load5, "zone", "load_mw"),
        "load_forecast_da": day_ahead_load_forecast(curated["load_forecast"], tz),
        "constraints_daily": constraints_daily(curated["da_constraints"], curated["rt_constraints"]),
        "daily_summary": daily_summary(system, hourly, fuel5, tz=tz),
        "fuel_mix_daily": fuel_mix_daily(fuel5, curated["btm_solar"], label, tz), "lbmp_zone_daily": zone_prices_daily(hourly),
    }
