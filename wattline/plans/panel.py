"""Point-in-time panel: one row per delivery hour and location, with every feature as it was known at the issue time.

Each feature block carries an `_avail_*` column, the latest publication time of any source row it used.  `audit` counts
rows where one of them lies after the issue; all counts must be 0.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline import settings as S
from wattline.functions.calendar import calendar_columns
from wattline.functions.clock import issue_time, local_date, local_midnight, local_time_on, to_local
from wattline.functions.numeric import degree_hours, price_components
from wattline.operators.asof import asof_few, asof_long
from wattline.operators.intervals import listed_outages, window_stats
from wattline.operators.reshape import calendar_lag
from wattline.session import cut_lineage
from wattline.settings import COMPONENTS, MARKET_TZ

RT_DELAY_MIN = 75               # interval end plus 15 minutes, from the interval start
LOAD_FILE_MINUTES = 510         # 08:30 local on the file date
DA_RESULT_MINUTES = 660         # 11:00 local on the day before delivery
OUTAGE_LIST_MINUTES = 600       # 10:00 local, conservative

KEYS = ["delivery_date", "ts_utc", "ts_local", "zone", "issue_utc"]
MASKS = ["score_da", "score_rt"]
CALENDAR = ["hour_local", "hour_index", "n_hours", "dow", "month", "is_weekend", "is_holiday", "doy_sin", "doy_cos"]
LAGS = [f"lag_{p}_{c}" for p in ("da_d1", "da_d7", "rt_d2") for c in COMPONENTS]
DAILY = ["da_d1_mean", "da_d1_max", "da_d1_min", "rt_d2_mean", "rt_d2_std", "rt_latest"]
LOAD = ["load_fcst_zone", "load_fcst_system", "load_fcst_system_daily_max"]
WEATHER = ["temp_fcst_zone", "temp_fcst_system", "hdh_zone", "cdh_zone"]
GRID = ["temp_fcst_zone_file", "hrrr_temp_zone", "hrrr_dewpoint_zone", "hrrr_wind80_zone", "hrrr_cloud_zone", "hrrr_cape_zone",
        "hrrr_refl40_zone", "hrrr_lightning_zone", "hrrr_temp_zone_dmean", "hrrr_temp_zone_dmax", "hrrr_temp_zone_dmin",
        "hrrr_temp_system", "hrrr_cape_system_max", "hrrr_refl40_system_max", "hrrr_lightning_system_max"]
LOAD_FIX = ["load_fix_zone", "load_surprise_zone", "load_fix_system", "load_surprise_system", "load_fix_system_daily_max"]
RESERVE = ["rt_spin_max_24h", "rt_spin_mean_24h", "rt_shortage_7d", "da_spin_max_d1", "dam_outages_d", "dam_outages_345_d"]
FUEL = ["gas_hh", "implied_hr_d1"]
FEATURE_SETS = {
    "v1": CALENDAR + LAGS + DAILY + LOAD + WEATHER + FUEL,
    "v2": CALENDAR + LAGS + DAILY + LOAD + WEATHER + GRID + FUEL,
    "v3": CALENDAR + LAGS + DAILY + LOAD + WEATHER + GRID + LOAD_FIX + FUEL,
    "v4": CALENDAR + LAGS + DAILY + LOAD + WEATHER + GRID + LOAD_FIX + RESERVE + FUEL,
}
FEATURES = FEATURE_SETS["v4"]


def future_rows(hourly: DataFrame, through: date, locations: list[str], tz: str = MARKET_TZ) -> DataFrame:
    """Hour x location rows for local days after the last priced one up to `through`, with NULL prices.

    Times come from a sequence, locations from a literal array, so no join is needed.
    """
    last = hourly.agg(F.max(F.to_date("ts_local")).alias("_last"))
    stop = local_midnight(F.date_add(F.lit(through), 1), tz) - F.expr("INTERVAL 1 HOUR")
    hours = last.filter(F.col("_last") < F.lit(through)).select(
        F.explode(F.sequence(local_midnight(F.date_add("_last", 1), tz), stop, F.expr("INTERVAL 1 HOUR"))).alias("ts_utc"))
    rows = hours.select("ts_utc", to_local(F.col("ts_utc"), tz).alias("ts_local"), F.explode(F.array(*[F.lit(z) for z in locations])).alias("zone"))
    missing = [f for f in hourly.schema.fields if f.name not in rows.columns]
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]).select(*hourly.columns)


def base_rows(hourly: DataFrame, start: date, tz: str = MARKET_TZ) -> DataFrame:
    """Delivery rows with targets, issue time and local hour."""
    day = F.to_date("ts_local")
    t = hourly.filter(day >= F.lit(start)).withColumn("delivery_date", day)
    targets = {f"{m}_{c}": v for m in S.MARKETS for c, v in price_components(f"{m}_lbmp", f"{m}_mlc", f"{m}_mcc").items()}
    t = t.withColumns({**targets, "issue_utc": issue_time(F.col("delivery_date"), tz), "hour_local": F.hour("ts_local")})
    return t.select(*KEYS, *targets, "rt_flag", "hour_local")


def day_positions(base: DataFrame) -> DataFrame:
    """hour_index and n_hours per (zone, day): a day has at most 25 rows, folded in one aggregate and exploded again."""
    g = base.groupBy("zone", "delivery_date").agg(F.array_sort(F.collect_list("ts_utc")).alias("_t"))
    return g.select("zone", "delivery_date", F.size("_t").alias("n_hours"), F.posexplode("_t").alias("hour_index", "ts_utc"))


def local_hour_prices(hourly: DataFrame) -> DataFrame:
    """Mean components per (zone, local day, local hour); the repeated hour is averaged."""
    comps = {f"{m}_{c}": v for m in S.MARKETS for c, v in price_components(f"{m}_lbmp", f"{m}_mlc", f"{m}_mcc").items()}
    return hourly.groupBy("zone", F.to_date("ts_local").alias("d"), F.hour("ts_local").alias("hr")).agg(
        F.max("ts_utc").alias("ts_max"), *[F.avg(v).alias(n) for n, v in comps.items()])


def daily_prices(px: DataFrame) -> DataFrame:
    return px.groupBy("zone", "d").agg(
        F.avg("da_total").alias("da_mean"), F.max("da_total").alias("da_max"), F.min("da_total").alias("da_min"),
        F.avg("rt_total").alias("rt_mean"), F.stddev_pop("rt_total").alias("rt_std"), F.max("ts_max").alias("ts_max"))


def station_weather(need: DataFrame, weather_fcst: DataFrame, anchor: str, stations: list[tuple[str, str]]) -> DataFrame:
    """Forecast per (need row, station) as known at `anchor`; the station list is a literal array on the need row."""
    codes = sorted({s for s, _ in stations})
    asked = need.withColumn("station", F.explode(F.array(*[F.lit(c) for c in codes])))
    return asof_few(asked, weather_fcst.select("ts_utc", "station", "available_utc", "temp_c"), ["ts_utc", "station"], anchor,
                    "available_utc", ["temp_c"])


def zone_and_system_weather(wx: DataFrame, keys: list[str], stations: list[tuple[str, str]], prefix: str) -> tuple[DataFrame, DataFrame]:
    zones: dict[str, list[str]] = {}
    for code, zone in stations:
        zones.setdefault(code, []).append(zone)
    mapping = F.create_map(*[x for c, z in zones.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in z]))])
    by_zone = wx.withColumn("zone", F.explode(mapping[F.col("station")])).groupBy(*keys, "zone").agg(
        F.avg("temp_c").alias(f"{prefix}_zone"), F.max("available_utc").alias(f"{prefix}_zone_avail"))
    system = wx.groupBy(*keys).agg(F.avg("temp_c").alias(f"{prefix}_sys"), F.max("available_utc").alias(f"{prefix}_sys_avail"))
    return by_zone, system


def build(src: dict[str, DataFrame], start: date = S.BURN_IN_START, through: date | None = None, locations: list[str] = S.LOCATIONS,
          stations: list[tuple[str, str]] = S.STATION_ZONES, system: str = S.SYSTEM_ZONE, tz: str = MARKET_TZ, stage: bool = True) -> DataFrame:
    """The panel.  `src`: lbmp_zone_hourly, load_forecast, weather_fcst, weather_hrrr, load_fix_oos, rt_asp, da_asp,
    da_sched_outages, gas_henry_hub.

    The base rows and the local-hour prices feed a dozen branches; with `stage` they are checkpointed once instead of
    being recomputed per branch.
    """
    n_internal = len({z for _, z in stations})
    hourly = src["lbmp_zone_hourly"].filter(F.col("zone").isin(locations))
    rows = hourly if through is None else hourly.unionByName(future_rows(hourly, through, locations, tz))
    base = base_rows(rows, start, tz)
    base = base.join(day_positions(base), ["zone", "delivery_date", "ts_utc"])
    px = local_hour_prices(hourly)
    if stage:
        base, px = cut_lineage(base), cut_lineage(px)
    daily = daily_prices(px)
    D = F.col("delivery_date")
    out = base.withColumns(calendar_columns(D))

    # lagged prices, by calendar date
    for tag, market, days in (("da_d1", "da", 1), ("da_d7", "da", 7), ("rt_d2", "rt", 2)):
        lag = px.select("zone", F.date_add("d", days).alias("delivery_date"), F.col("hr").alias("hour_local"),
                        *[F.col(f"{market}_{c}").alias(f"lag_{tag}_{c}") for c in COMPONENTS],
                        *([F.col("ts_max").alias("_px_max")] if tag == "rt_d2" else []))
        out = out.join(lag, ["zone", "delivery_date", "hour_local"], "left")
    d1 = calendar_lag(daily.withColumnRenamed("d", "delivery_date"), ["zone"], "delivery_date", 1, ["da_mean", "da_max", "da_min"], "_1")
    d2 = calendar_lag(daily.withColumnRenamed("d", "delivery_date"), ["zone"], "delivery_date", 2, ["rt_mean", "rt_std", "ts_max"], "_2")
    out = out.join(d1, ["zone", "delivery_date"], "left").join(d2, ["zone", "delivery_date"], "left")

    # latest real-time price at issue: long right side
    known = hourly.filter("rt_lbmp IS NOT NULL").select(
        "zone", (F.col("ts_utc") + F.expr(f"INTERVAL {RT_DELAY_MIN} MINUTE")).alias("_rtl_avail"), F.col("rt_lbmp").alias("rt_latest"))
    issues = base.select("zone", "issue_utc").distinct()
    out = out.join(asof_long(issues, known, ["zone"], "issue_utc", "_rtl_avail", ["rt_latest"]), ["zone", "issue_utc"], "left")

    # load forecast vintages
    lf = src["load_forecast"].select("ts_utc", "zone", "load_forecast_mw",
                                     local_time_on(F.col("issue_date"), LOAD_FILE_MINUTES, tz).alias("_lf_avail"))
    times = base.select("ts_utc", "issue_utc").distinct()
    lfz = asof_few(base.select("ts_utc", "zone", "issue_utc"), lf, ["ts_utc", "zone"], "issue_utc", "_lf_avail", ["load_forecast_mw"])
    out = out.join(lfz.select("ts_utc", "zone", F.col("load_forecast_mw").alias("load_fcst_zone"), F.col("_lf_avail").alias("_lfz_avail")),
                   ["ts_utc", "zone"], "left")
    lfn = asof_few(times, lf.filter(F.col("zone") == system).drop("zone"), ["ts_utc"], "issue_utc", "_lf_avail", ["load_forecast_mw"])
    lfn = lfn.select("ts_utc", F.col("load_forecast_mw").alias("load_fcst_system"), F.col("_lf_avail").alias("_lfn_avail"))
    lfd = lfn.groupBy(local_date(F.col("ts_utc"), tz).alias("delivery_date")).agg(
        F.max("load_fcst_system").alias("load_fcst_system_daily_max"), F.max("_lfn_avail").alias("_lfd_avail"))
    out = out.join(lfn, "ts_utc", "left").join(lfd, "delivery_date", "left")

    # station forecasts at the issue and at the load file's publication
    wz, ws = zone_and_system_weather(station_weather(times, src["weather_fcst"], "issue_utc", stations), ["ts_utc"], stations, "_w")
    at_file = base.select("ts_utc", local_time_on(F.date_sub(D, 2), LOAD_FILE_MINUTES, tz).alias("file_utc")).distinct()
    fz, fs = zone_and_system_weather(station_weather(at_file, src["weather_fcst"], "file_utc", stations), ["ts_utc"], stations, "_f")
    out = (out.join(wz, ["ts_utc", "zone"], "left").join(ws, "ts_utc", "left").join(fz, ["ts_utc", "zone"], "left").join(fs, "ts_utc", "left"))

    # gridded forecast
    fields = {"temp_c": "temp", "dewpoint_c": "dewpoint", "wind80_ms": "wind80", "cloud_pct": "cloud", "cape_p90": "cape",
              "refl40_share": "refl40", "lightning_density": "lightning"}
    hr = asof_few(base.select("ts_utc", "zone", "delivery_date", "issue_utc"), src["weather_hrrr"], ["ts_utc", "zone"], "issue_utc",
                  "available_utc", list(fields))
    hr = hr.select("ts_utc", "zone", "delivery_date", *[F.col(s).alias(f"hrrr_{d}_zone") for s, d in fields.items()], F.col("available_utc").alias("_hr_avail"))
    hd = hr.groupBy("zone", "delivery_date").agg(*[fn("hrrr_temp_zone").alias(f"hrrr_temp_zone_d{n}") for n, fn in
                                                  (("mean", F.avg), ("max", F.max), ("min", F.min))], F.max("_hr_avail").alias("_hd_avail"))
    hs = hr.groupBy("ts_utc").agg(F.avg("hrrr_temp_zone").alias("hrrr_temp_system"), F.max("hrrr_cape_zone").alias("hrrr_cape_system_max"),
                                  F.max("hrrr_refl40_zone").alias("hrrr_refl40_system_max"),
                                  F.max("hrrr_lightning_zone").alias("hrrr_lightning_system_max"), F.max("_hr_avail").alias("_hs_avail"))
    out = out.join(hr.drop("delivery_date"), ["ts_utc", "zone"], "left").join(hd, ["zone", "delivery_date"], "left").join(hs, "ts_utc", "left")

    # weather-corrected load
    fix = src["load_fix_oos"]
    fx = fix.select("ts_utc", "zone", F.col("load_fix").alias("load_fix_zone"), F.col("r_hat").alias("load_surprise_zone"))
    fsys = fix.groupBy("ts_utc").agg(F.sum("load_fix").alias("_fix"), F.sum(F.col("load_fix") / (1 + F.col("r_hat"))).alias("_file"),
                                     F.count(F.lit(1)).alias("_nfix"))
    whole = F.col("_nfix") == n_internal
    fsys = fsys.select("ts_utc", F.col("_fix"), F.when(whole, F.col("_fix")).alias("load_fix_system"),
                       F.when(whole, F.col("_fix") / F.col("_file") - 1).alias("load_surprise_system"))
    fday = fsys.groupBy(local_date(F.col("ts_utc"), tz).alias("delivery_date")).agg(F.max("load_fix_system").alias("load_fix_system_daily_max"))
    out = out.join(fx, ["ts_utc", "zone"], "left").join(fsys, "ts_utc", "left").join(fday, "delivery_date", "left")

    # reserves and outages
    rsv = window_stats(src["rt_asp"].select("zone", "ts_utc", "spin_10", "or_30"), issues, ["zone"], "ts_utc", "issue_utc", "spin_10", "or_30")
    rsv = rsv.select("zone", "issue_utc", F.col("recent_max").alias("rt_spin_max_24h"), F.col("recent_mean").alias("rt_spin_mean_24h"),
                     F.col("shortage").alias("rt_shortage_7d"), F.col("avail").alias("_rsv_avail"))
    dasp = src["da_asp"].groupBy("zone", F.date_add(F.to_date("ts_local"), 1).alias("delivery_date")).agg(F.max("spin_10").alias("da_spin_max_d1"))
    lists = src["da_sched_outages"].select(F.to_date("ts_local").alias("list_day"), "equipment", "sched_out_utc", "sched_in_utc")
    damo = listed_outages(lists, tz).withColumnsRenamed({"dam_outages": "dam_outages_d", "dam_outages_345": "dam_outages_345_d"})
    out = out.join(rsv, ["zone", "issue_utc"], "left").join(dasp, ["zone", "delivery_date"], "left").join(damo, "delivery_date", "left")

    # fuel
    gas = src["gas_henry_hub"].select(F.lit(1).alias("_one"), F.col("available_utc").alias("_gas_avail"), F.col("price_usd_mmbtu").alias("gas_hh"))
    asks = base.select("issue_utc").distinct().withColumn("_one", F.lit(1))
    gas = asof_long(asks, gas, ["_one"], "issue_utc", "_gas_avail", ["gas_hh"]).drop("_one")
    out = out.join(gas, "issue_utc", "left")

    temp = F.coalesce("_w_zone", "_w_sys")
    heat, cool = degree_hours(temp)
    da_known = lambda back: local_time_on(F.date_sub(D, back + 1), DA_RESULT_MINUTES, tz)             # noqa: E731
    has_fix = F.coalesce("load_fix_zone", "_fix").isNotNull()
    audit_cols: dict[str, Column] = {
        "_avail_lag_da_d1": da_known(1), "_avail_lag_da_d7": da_known(7),
        "_avail_lag_rt_d2": F.col("_px_max") + F.expr(f"INTERVAL {RT_DELAY_MIN} MINUTE"),
        "_avail_rt_d2_stats": F.col("ts_max_2") + F.expr(f"INTERVAL {RT_DELAY_MIN} MINUTE"), "_avail_rt_latest": F.col("_rtl_avail"),
        "_avail_load_fcst": F.greatest("_lfz_avail", "_lfn_avail", "_lfd_avail"), "_avail_temp_fcst": F.greatest("_w_zone_avail", "_w_sys_avail"),
        "_avail_temp_fcst_file": F.greatest("_f_zone_avail", "_f_sys_avail"), "_avail_grid": F.greatest("_hr_avail", "_hd_avail", "_hs_avail"),
        "_avail_load_fix": F.when(has_fix, F.greatest("_hs_avail", "_lfd_avail", "_lfz_avail", "_f_sys_avail", "_f_zone_avail")),
        "_avail_gas": F.col("_gas_avail"), "_avail_rt_reserve": F.col("_rsv_avail"),
        "_avail_da_reserve": F.when(F.col("da_spin_max_d1").isNotNull(), da_known(1)),
        "_avail_dam_outages": F.when(F.col("dam_outages_d").isNotNull(), local_time_on(F.date_sub(D, 2), OUTAGE_LIST_MINUTES, tz)),
    }
    out = out.withColumns({
        "da_d1_mean": F.col("da_mean_1"), "da_d1_max": F.col("da_max_1"), "da_d1_min": F.col("da_min_1"), "rt_d2_mean": F.col("rt_mean_2"),
        "rt_d2_std": F.col("rt_std_2"), "temp_fcst_zone": temp, "temp_fcst_system": F.col("_w_sys"), "hdh_zone": heat, "cdh_zone": cool,
        "temp_fcst_zone_file": F.coalesce("_f_zone", "_f_sys"), "implied_hr_d1": F.try_divide("da_mean_1", "gas_hh"),
        "score_da": F.col("da_total").isNotNull(), "score_rt": F.col("rt_total").isNotNull() & F.col("rt_flag").isNull(), **audit_cols})
    return out.select(*KEYS, *S.TARGETS, *FEATURES, *MASKS, *audit_cols)


def avail_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_avail_")]


def audit(panel: DataFrame, issue: str = "issue_utc") -> DataFrame:
    """(block, violations, populated): one pass over the panel for all blocks."""
    cols = avail_columns(panel)
    agg = panel.agg(*[F.struct(F.count_if(F.col(c) > F.col(issue)).alias("violations"), F.count(c).alias("populated")).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("block"), F.col(f"{c}.violations").alias("violations"), F.col(f"{c}.populated").alias("populated")) for c in cols])
    return agg.select(F.inline(rows))


def load(panel: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Delivery dates in [start, end); the stored panel is partitioned by month, which the same predicate prunes."""
    conds = []
    if start is not None:
        conds.append(F.col("delivery_date") >= F.lit(start))
    if end is not None:
        conds.append(F.col("delivery_date") < F.lit(end))
    return panel.filter(reduce(lambda a, b: a & b, conds)) if conds else panel


def context_frames(panel: DataFrame, day: date, market: str, covariates: list[str], context_days: int = 28, tz: str = MARKET_TZ
                   ) -> tuple[DataFrame, DataFrame]:
    """(context, future) on a full hourly grid per zone for a sequence model.

    The context ends before the delivery day (da), or one hour before the issue hour (rt), so it holds nothing published
    after the issue.
    """
    start, stop = local_midnight(F.lit(day), tz), local_midnight(F.date_add(F.lit(day), 1), tz)
    cut = start if market == "da" else F.date_trunc("hour", issue_time(F.lit(day), tz)) - F.expr("INTERVAL 1 HOUR")
    hour = F.expr("INTERVAL 1 HOUR")
    zones = panel.select("zone").distinct()
    src = panel.select("zone", "ts_utc", F.col(f"{market}_total").alias("target"), *covariates).dropDuplicates(["zone", "ts_utc"])
    first = cut - F.expr(f"INTERVAL {context_days} DAY")
    src = src.filter((F.col("ts_utc") >= first) & (F.col("ts_utc") < stop))
    ctx = zones.withColumn("ts_utc", F.explode(F.sequence(first, cut - hour, hour))).join(src, ["zone", "ts_utc"], "left")
    fut = zones.withColumn("ts_utc", F.explode(F.sequence(cut, stop - hour, hour))).join(src.drop("target"), ["zone", "ts_utc"], "left")
    return ctx, fut

