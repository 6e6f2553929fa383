"""The point-in-time panel over sources derived from `events`, its audit, and its lag features."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from wattline.checks.base import Tables, check, rounded
from wattline.checks.warehouse import PRICES_SQL, hourly_prices
from wattline.functions.clock import local_date, local_midnight, to_local
from wattline.operators.audit import column_checksums
from wattline.plans import panel
from wattline.session import cut_lineage

ZONES = ["click", "error", "purchase", "signup", "view"]
STATIONS = [("c1", "click"), ("e1", "error"), ("p1", "purchase"), ("s1", "signup"), ("v1", "view"), ("v2", "view")]
START = date(2024, 10, 27)


def sources(t: Tables):
    """All panel inputs from hourly event means; forecasts are the hour's own value plus an error that grows with lead."""
    hourly = cut_lineage(hourly_prices(t)[0])       # a stored table in a warehouse
    h = t.shifted().groupBy(F.date_trunc("hour", "ts_utc").alias("ts_utc"), "zone").agg(F.avg("value").alias("v"), F.max("value").alias("m"))
    day = local_date(F.col("ts_utc"))
    with_total = h.unionByName(h.groupBy("ts_utc").agg(F.sum("v").alias("v"), F.max("m").alias("m")).withColumn("zone", F.lit("SYSTEM")))
    lf = with_total.select("ts_utc", "zone", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), "v").select(
        "ts_utc", "zone", F.date_sub(day, F.col("k")).alias("issue_date"), (F.col("v") * 10 + F.col("k")).alias("load_forecast_mw"))
    st = F.explode(F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(z).alias("z")) for s, z in STATIONS]), lambda x: x["z"] == F.col("zone")))
    wx = h.withColumn("_s", st).select("ts_utc", F.col("_s.s").alias("station"), "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("lead_days"))
    wx = wx.select("ts_utc", "station", "lead_days", (F.col("v") / 4 + F.col("lead_days")).alias("temp_c"),
                   (F.col("ts_utc") - F.make_dt_interval(F.col("lead_days")) + F.expr("INTERVAL 6 HOUR")).alias("available_utc"))
    run = F.date_sub(day, 1).cast("timestamp") + F.expr("INTERVAL 6 HOUR")
    grid = h.select("ts_utc", "zone", run.alias("run_utc"), (F.col("v") / 4).alias("temp_c"), (F.col("v") / 5).alias("dewpoint_c"), (F.col("v") / 10).alias("wind80_ms"), F.col("v").alias("cloud_pct"),
                    F.col("m").alias("cape_p90"), (F.col("v") / 500).alias("refl40_share"), (F.col("v") / 100).alias("lightning_density"), (run + F.expr("INTERVAL 2 HOUR")).alias("available_utc"))
    asp = t.shifted().select("ts_utc", to_local(F.col("ts_utc")).alias("ts_local"), "zone", F.col("value").alias("spin_10"), (F.col("value") - 20).alias("or_30"))
    outs = t.shifted().select(to_local(F.col("ts_utc")).alias("ts_local"), F.concat(F.lit("E"), F.col("user_id").cast("string"), F.when(F.col("zone") == "view", "_345").otherwise("_115")).alias("equipment"),
                              (F.col("ts_utc") - F.expr("INTERVAL 1 DAY")).alias("sched_out_utc"), (F.col("ts_utc") + F.make_dt_interval(hours=F.col("value").cast("int"))).alias("sched_in_utc"))
    gas = h.groupBy(day.alias("trade_date")).agg((F.avg("v") / 10).alias("price_usd_mmbtu"))
    gas = gas.withColumn("available_utc", local_midnight(F.date_add("trade_date", 1)))
    fix = h.select("ts_utc", "zone", (F.col("v") * 10).alias("load_fix"), F.lit(0.02).alias("r_hat"))
    return {"lbmp_zone_hourly": hourly, "load_forecast": lf, "weather_fcst": wx, "weather_hrrr": grid, "load_fix_oos": fix, "rt_asp": asp, "da_asp": asp, "da_sched_outages": outs, "gas_henry_hub": gas}


def build(t: Tables, through: date | None = None):
    return panel.build(sources(t), START, through, ZONES, STATIONS)


BLOCKS = ["_avail_lag_da_d1", "_avail_lag_da_d7", "_avail_lag_rt_d2", "_avail_rt_d2_stats", "_avail_rt_latest", "_avail_load_fcst", "_avail_temp_fcst", "_avail_temp_fcst_file", "_avail_grid", "_avail_load_fix",
          "_avail_gas", "_avail_rt_reserve", "_avail_da_reserve", "_avail_dam_outages"]


@check("panel_availability_audit", "SELECT unnest([" + ", ".join(f"'{b}'" for b in BLOCKS) + "]) AS block, CAST(0 AS BIGINT) AS violations, count(*) > 0 AS has_rows FROM events")
def availability_audit(t: Tables):
    """Every block must be populated and none may use a row published after the issue."""
    return panel.audit(build(t)).select("block", "violations", (F.col("populated") > 0).alias("has_rows"))


LAG_SQL = f"""{PRICES_SQL}, b AS (SELECT ts_utc, CAST(ts_local AS DATE) AS dd, zone, CAST(hour(ts_local) AS INTEGER) AS hr, da_lbmp, rt_lbmp, rt_flag FROM zph),
b2 AS (SELECT *, row_number() OVER (PARTITION BY zone, dd ORDER BY ts_utc) - 1 AS hi, count(*) OVER (PARTITION BY zone, dd) AS nh FROM b),
px AS (SELECT zone, dd, hr, avg(da_lbmp) AS da, avg(rt_lbmp) AS rt FROM b GROUP BY 1, 2, 3), dl AS (SELECT zone, dd, avg(da) AS dm, max(da) AS dx, min(da) AS dn, avg(rt) AS rm, stddev_pop(rt) AS rs FROM px GROUP BY 1, 2),
iss AS (SELECT *, timezone('UTC', timezone('America/New_York', CAST(dd - 1 AS TIMESTAMP) + INTERVAL 5 HOUR)) AS issue_utc FROM b2),
av AS (SELECT zone, ts_utc + INTERVAL 75 MINUTE AS a, rt_lbmp AS v FROM b WHERE rt_lbmp IS NOT NULL)"""


@check("panel_lag_features", f"""WITH {LAG_SQL}, rl AS (SELECT i.zone, i.issue_utc, av.v FROM (SELECT DISTINCT zone, issue_utc FROM iss) i ASOF JOIN av ON av.zone = i.zone AND i.issue_utc >= av.a)
SELECT i.ts_utc, i.zone, i.issue_utc, i.hr AS hour_local, CAST(hi AS INTEGER) AS hour_index, CAST(nh AS INTEGER) AS n_hours, round(p1.da, 6) AS lag_da_d1_total, round(p7.da, 6) AS lag_da_d7_total, round(p2.rt, 6) AS lag_rt_d2_total,
round(d1.dm, 6) AS da_d1_mean, round(d1.dx, 6) AS da_d1_max, round(d1.dn, 6) AS da_d1_min, round(d2.rm, 6) AS rt_d2_mean, round(d2.rs, 6) AS rt_d2_std, round(rl.v, 6) AS rt_latest, i.da_lbmp IS NOT NULL AS score_da,
i.rt_lbmp IS NOT NULL AND i.rt_flag IS NULL AS score_rt
FROM iss i LEFT JOIN px p1 ON p1.zone = i.zone AND p1.dd = i.dd - 1 AND p1.hr = i.hr LEFT JOIN px p7 ON p7.zone = i.zone AND p7.dd = i.dd - 7 AND p7.hr = i.hr LEFT JOIN px p2 ON p2.zone = i.zone AND p2.dd = i.dd - 2 AND p2.hr = i.hr
LEFT JOIN dl d1 ON d1.zone = i.zone AND d1.dd = i.dd - 1 LEFT JOIN dl d2 ON d2.zone = i.zone AND d2.dd = i.dd - 2 LEFT JOIN rl ON rl.zone = i.zone AND rl.issue_utc = i.issue_utc WHERE i.dd >= DATE '{START}'""")
def lag_features(t: Tables):
    return rounded(build(t).select("ts_utc", "zone", "issue_utc", "hour_local", "hour_index", "n_hours", "lag_da_d1_total", "lag_da_d7_total", "lag_rt_d2_total", "da_d1_mean", "da_d1_max", "da_d1_min", "rt_d2_mean",
                                   "rt_d2_std", "rt_latest", "score_da", "score_rt"))


@check("panel_forecast_features", f"""WITH {LAG_SQL}, h AS (SELECT date_trunc('hour', ts_utc) AS ts_utc, zone, avg(value) AS v FROM ev GROUP BY 1, 2), s AS (SELECT ts_utc, sum(v) AS v FROM h GROUP BY 1)
SELECT i.ts_utc, i.zone, round(h.v * 10 + 2, 6) AS load_fcst_zone, round(s.v * 10 + 2, 6) AS load_fcst_system, round(h.v / 4, 6) AS hrrr_temp_zone, round(h.v * 10, 6) AS load_fix_zone FROM iss i LEFT JOIN h USING (ts_utc, zone) LEFT JOIN s USING (ts_utc) WHERE i.dd >= DATE '{START}'""")
def forecast_features(t: Tables):
    """A 05:00 issue on D-1 sees the load file of D-2, not the one of D-1, and the gridded run of 06 UTC two hours after its start."""
    p = build(t)
    known = p.select("ts_utc", "zone", "load_fcst_zone", "load_fcst_system", "load_fix_zone", "hrrr_temp_zone", "issue_utc")
    return rounded(known.drop("issue_utc"))


@check("panel_future_rows")
def future(t: Tables):
    """Rows after the last priced day carry features but no targets."""
    p = build(t, date(2024, 11, 28)).filter("delivery_date > DATE '2024-11-26'")
    return p.groupBy("delivery_date").agg(F.count(F.lit(1)).alias("n"), F.count("da_total").alias("priced"), F.count("lag_da_d1_total").alias("with_lag"))


@check("panel_checksums")
def checksums(t: Tables):
    return column_checksums(build(t), ["ts_utc", "zone"])


@check("sequence_context")
def context(t: Tables):
    ctx, fut = panel.context_frames(build(t), date(2024, 11, 20), "rt", ["load_fcst_system"], context_days=14)
    a = ctx.groupBy("zone").agg(F.count(F.lit(1)).alias("context_hours"), F.count("target").alias("known"), F.max("ts_utc").alias("last_context"))
    return rounded(a.join(fut.groupBy("zone").agg(F.count(F.lit(1)).alias("future_hours")), "zone"))
