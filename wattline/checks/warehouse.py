"""Time weighting, derived tables, runs, coverage, deduplication, clock and calendar."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from wattline.checks.base import BOOK_SQL, LOCAL, SHIFTED_SQL, Tables, check, rounded
from wattline.functions import clock
from wattline.functions.calendar import calendar_columns, is_holiday, peak_period
from wattline.functions.numeric import degree_hours, safe_ratio, weighted_mean
from wattline.operators import audit
from wattline.operators.ordered import exact_quantiles, keep_last, row_index
from wattline.operators.runs import compact_snapshots
from wattline.operators.timeweight import time_weighted
from wattline.plans import derived
from wattline.sources import external, warehouse

GAP = 3600


def _twa_sql(bucket: str, stamped: str, name: str = "twa", source: str = "ev", entity: str = "zone", values: str = "value", gap: str = "1 HOUR") -> str:
    if stamped == "end":
        spans = f"""SELECT {entity}, {values}, end_ts, CASE WHEN prev IS NULL OR end_ts - prev > INTERVAL {gap} THEN end_ts - INTERVAL 5 MINUTE ELSE prev END AS start_ts
          FROM (SELECT {entity}, {values}, ts_utc + INTERVAL 5 MINUTE AS end_ts, lag(ts_utc + INTERVAL 5 MINUTE) OVER (PARTITION BY {entity} ORDER BY ts_utc) AS prev FROM {source})"""
    else:
        spans = f"""SELECT {entity}, {values}, start_ts, CASE WHEN nxt IS NULL OR nxt - start_ts > INTERVAL {gap} THEN start_ts + INTERVAL 5 MINUTE ELSE nxt END AS end_ts
          FROM (SELECT {entity}, {values}, ts_utc AS start_ts, lead(ts_utc) OVER (PARTITION BY {entity} ORDER BY ts_utc) AS nxt FROM {source})"""
    weighted = ", ".join(f"sum({v.strip()} * w) / sum(w) AS {v.strip()}" for v in values.split(","))
    return f"""{name} AS (SELECT b AS ts_utc, {entity}, {weighted}, sum(w) AS covered_s FROM (
      SELECT b, {entity}, {values}, epoch(least(end_ts, b + INTERVAL {bucket}) - greatest(start_ts, b)) AS w FROM (
        SELECT *, unnest(generate_series(time_bucket(INTERVAL {bucket}, start_ts), time_bucket(INTERVAL {bucket}, end_ts - INTERVAL 1 MICROSECOND), INTERVAL {bucket})) AS b
        FROM ({spans}))) WHERE w > 0 GROUP BY b, {entity})"""


@check("twa_end_5m", f"WITH {SHIFTED_SQL}, {_twa_sql('5 MINUTE', 'end')} SELECT ts_utc, zone, round(value, 6) AS value, round(covered_s, 6) AS covered_s FROM twa")
def twa_end(t: Tables):
    return rounded(time_weighted(t.shifted(), ["zone"], ["value"], 300, max_gap=GAP))


@check("twa_start_1h", f"WITH {SHIFTED_SQL}, {_twa_sql('1 HOUR', 'start')} SELECT ts_utc, zone, round(value, 6) AS value, round(covered_s, 6) AS covered_s FROM twa")
def twa_start(t: Tables):
    return rounded(time_weighted(t.shifted(), ["zone"], ["value"], 3600, stamped="start", max_gap=GAP))


@check("twa_hourly_reweighted", f"""WITH {SHIFTED_SQL}, {_twa_sql('5 MINUTE', 'end')}
SELECT date_trunc('hour', ts_utc) AS ts_utc, zone, round(sum(value * covered_s) / sum(covered_s), 6) AS value, round(sum(covered_s), 6) AS covered_s FROM twa GROUP BY 1, 2""")
def twa_hourly(t: Tables):
    five = time_weighted(t.shifted(), ["zone"], ["value"], 300, max_gap=GAP)
    return rounded(five.groupBy(F.date_trunc("hour", "ts_utc").alias("ts_utc"), "zone").agg(
        weighted_mean(F.col("value"), F.col("covered_s")).alias("value"), F.sum("covered_s").alias("covered_s")))


def _five(t: Tables, value: str = "load_mw", entity: str = "zone"):
    s = t.shifted().withColumnsRenamed({"value": value, "zone": entity} if entity != "zone" else {"value": value})
    return time_weighted(s, [entity], [value], 300, max_gap=GAP)


@check("system_total_rows", f"""WITH {SHIFTED_SQL}, {_twa_sql('5 MINUTE', 'end')}
SELECT ts_utc, zone, round(value, 6) AS load_mw, round(covered_s, 6) AS covered_s FROM twa
UNION ALL SELECT ts_utc, 'SYSTEM', round(sum(value), 6), round(min(covered_s), 6) FROM twa GROUP BY 1""")
def system_total(t: Tables):
    return rounded(derived.with_system_total(_five(t)))


@check("system_series_5m", f"""WITH {SHIFTED_SQL}, {_twa_sql('5 MINUTE', 'end')}, tot AS (SELECT ts_utc, sum(value) AS load_mw, min(covered_s) AS covered_s FROM twa GROUP BY 1)
SELECT tot.ts_utc, {LOCAL.format('tot.ts_utc')} AS ts_local, round(load_mw, 6) AS load_mw, round(covered_s, 6) AS covered_s, round(load_mw - w.value, 6) AS net_load_mw, round(p.v, 6) AS rt_lbmp
FROM tot LEFT JOIN (SELECT ts_utc, value FROM twa WHERE zone = 'view') w USING (ts_utc)
LEFT JOIN (SELECT ts_utc, avg(value) AS v FROM twa WHERE zone NOT IN ('signup', 'error') GROUP BY 1) p USING (ts_utc)""")
def system_series(t: Tables):
    five = _five(t)
    fuel = five.select("ts_utc", F.col("zone").alias("fuel"), F.col("load_mw").alias("gen_mw"))
    price = five.select("ts_utc", "zone", F.col("load_mw").alias("lbmp"))
    return rounded(derived.system_5m(derived.with_system_total(five), fuel, price, external=["signup", "error"], wind="view"))


PRICES_SQL = f"""{SHIFTED_SQL}, rtz AS (SELECT ts_utc, zone, value AS lbmp, value * 0.1 AS mlc, (value - 20) * 0.05 AS mcc FROM ev),
{_twa_sql('5 MINUTE', 'end', 'p5', 'rtz', 'zone', 'lbmp, mlc, mcc', '15 MINUTE')},
hourly AS (SELECT date_trunc('hour', ts_utc) AS ts_utc, zone, count(*) AS n, avg(lbmp) AS lbmp, avg(mlc) AS mlc, avg(mcc) AS mcc, max(lbmp) AS top FROM rtz GROUP BY 1, 2),
da AS (SELECT ts_utc, zone, top AS lbmp, mlc, mcc FROM hourly),
pub AS (SELECT ts_utc, zone, lbmp, mlc, mcc, 'integrated' AS rt_source FROM hourly WHERE n >= 2),
der AS (SELECT date_trunc('hour', ts_utc) AS ts_utc, zone, sum(lbmp * covered_s) / sum(covered_s) AS lbmp, sum(mlc * covered_s) / sum(covered_s) AS mlc,
  sum(mcc * covered_s) / sum(covered_s) AS mcc, 'derived_twa' AS rt_source FROM p5 GROUP BY 1, 2),
r AS (SELECT * FROM pub UNION ALL SELECT * FROM der ANTI JOIN pub USING (ts_utc, zone)),
zph AS (SELECT coalesce(d.ts_utc, r.ts_utc) AS ts_utc, {LOCAL.format('coalesce(d.ts_utc, r.ts_utc)')} AS ts_local, coalesce(d.zone, r.zone) AS zone, d.lbmp AS da_lbmp, d.mlc AS da_mlc,
  d.mcc AS da_mcc, r.lbmp AS rt_lbmp, r.mlc AS rt_mlc, r.mcc AS rt_mcc, r.rt_source,
  CASE WHEN r.rt_source = 'integrated' AND abs(r.lbmp - x.lbmp) >= 0.02 THEN 'integrated_vs_5m_mismatch' END AS rt_flag, d.lbmp - r.lbmp AS da_rt_spread
  FROM da d FULL JOIN r ON d.ts_utc = r.ts_utc AND d.zone = r.zone LEFT JOIN der x ON x.ts_utc = r.ts_utc AND x.zone = r.zone)"""


def hourly_prices(t: Tables):
    """(zone-hour price table, 5-minute prices) from the shifted events."""
    rt = t.shifted().select("ts_utc", "zone", F.col("value").alias("lbmp"), (F.col("value") * 0.1).alias("mlc"), ((F.col("value") - 20) * 0.05).alias("mcc"))
    p5 = derived.zone_prices_5m(rt)
    h = rt.groupBy(F.date_trunc("hour", "ts_utc").alias("ts_utc"), "zone").agg(F.count(F.lit(1)).alias("n"), F.avg("lbmp").alias("lbmp"), F.avg("mlc").alias("mlc"),
                                                                              F.avg("mcc").alias("mcc"), F.max("lbmp").alias("top"))
    da = h.select("ts_utc", "zone", F.col("top").alias("lbmp"), "mlc", "mcc")
    return derived.zone_prices_hourly(da, h.filter("n >= 2"), p5), p5


@check("zone_prices_hourly", f"""WITH {PRICES_SQL} SELECT ts_utc, ts_local, zone, round(da_lbmp, 6) AS da_lbmp, round(da_mlc, 6) AS da_mlc, round(da_mcc, 6) AS da_mcc, round(rt_lbmp, 6) AS rt_lbmp,
round(rt_mlc, 6) AS rt_mlc, round(rt_mcc, 6) AS rt_mcc, rt_source, rt_flag, round(da_rt_spread, 6) AS da_rt_spread FROM zph""")
def zone_prices_hourly(t: Tables):
    return rounded(hourly_prices(t)[0])


@check("zone_prices_daily", f"""WITH {PRICES_SQL} SELECT CAST(ts_local AS DATE) AS day, zone, round(avg(da_lbmp), 6) AS avg_da_lbmp, round(avg(rt_lbmp), 6) AS avg_rt_lbmp,
round(avg(da_rt_spread), 6) AS avg_spread FROM zph GROUP BY 1, 2""")
def zone_prices_daily(t: Tables):
    return rounded(derived.zone_prices_daily(hourly_prices(t)[0]))


@check("fuel_mix_hourly", f"""WITH {SHIFTED_SQL}, {_twa_sql('5 MINUTE', 'end', gap='15 MINUTE')}
SELECT date_trunc('hour', ts_utc) AS ts_utc, zone AS fuel, round(sum(value * covered_s) / sum(covered_s), 6) AS gen_mw FROM twa GROUP BY 1, 2""")
def fuel_hourly(t: Tables):
    s = t.shifted().select("ts_utc", F.col("zone").alias("fuel"), F.col("value").alias("gen_mw"))
    return rounded(derived.hourly_weighted(derived.fuel_mix_5m(s), "fuel", "gen_mw"))


@check("fuel_mix_daily", f"""WITH {SHIFTED_SQL}, {_twa_sql('5 MINUTE', 'end', gap='15 MINUTE')}
SELECT CAST({LOCAL.format('ts_utc')} AS DATE) AS day, zone AS fuel, round(sum(value * covered_s) / sum(covered_s), 6) AS avg_mw FROM twa GROUP BY 1, 2
UNION ALL SELECT CAST({LOCAL.format('ts_utc')} AS DATE), 'BTM Solar', round(avg(value), 6) FROM ev WHERE zone = 'view' GROUP BY 1""")
def fuel_daily(t: Tables):
    s = t.shifted()
    solar = s.select(clock.to_local(F.col("ts_utc")).alias("ts_local"), "zone", F.col("value").alias("mw"))
    five = derived.fuel_mix_5m(s.select("ts_utc", F.col("zone").alias("fuel"), F.col("value").alias("gen_mw")))
    return rounded(derived.fuel_mix_daily(five, solar, label="view"))


@check("daily_summary", f"""WITH {PRICES_SQL}, {_twa_sql('5 MINUTE', 'end')}, tot AS (SELECT ts_utc, sum(value) AS load_mw, min(covered_s) AS covered_s FROM twa GROUP BY 1),
sys AS (SELECT CAST({LOCAL.format('tot.ts_utc')} AS DATE) AS day, load_mw, covered_s, load_mw - w.value AS net FROM tot LEFT JOIN (SELECT ts_utc, value FROM twa WHERE zone = 'Wind') w USING (ts_utc)),
s AS (SELECT day, sum(load_mw * covered_s) / sum(covered_s) AS avg_load_mw, max(load_mw) AS peak_load_mw, sum(net * covered_s) / sum(covered_s) AS avg_net_load_mw FROM sys GROUP BY 1),
p AS (SELECT CAST(ts_local AS DATE) AS day, avg(da_lbmp) AS avg_da_lbmp, avg(rt_lbmp) AS avg_rt_lbmp FROM zph GROUP BY 1),
named AS (SELECT ts_utc, CASE zone WHEN 'view' THEN 'Wind' WHEN 'click' THEN 'Hydro' WHEN 'error' THEN 'Nuclear' ELSE zone END AS fuel, value, covered_s FROM twa),
fm AS (SELECT CAST({LOCAL.format('ts_utc')} AS DATE) AS day, fuel, sum(value * covered_s) / sum(covered_s) AS avg_mw FROM named GROUP BY 1, 2),
f AS (SELECT day, arg_max(fuel, avg_mw) AS main_source, sum(avg_mw) AS avg_gen_mw, sum(avg_mw) FILTER (fuel IN ('Wind', 'Hydro')) / sum(avg_mw) AS renewable_share,
  sum(avg_mw) FILTER (fuel IN ('Wind', 'Hydro', 'Nuclear')) / sum(avg_mw) AS carbon_free_share FROM fm GROUP BY 1)
SELECT s.day, round(avg_load_mw, 6) AS avg_load_mw, round(peak_load_mw, 6) AS peak_load_mw, round(avg_net_load_mw, 6) AS avg_net_load_mw, round(avg_da_lbmp, 6) AS avg_da_lbmp,
round(avg_rt_lbmp, 6) AS avg_rt_lbmp, main_source, round(avg_gen_mw, 6) AS avg_gen_mw, round(renewable_share, 6) AS renewable_share, round(carbon_free_share, 6) AS carbon_free_share
FROM s LEFT JOIN p USING (day) LEFT JOIN f USING (day)""".replace("WHERE zone = 'Wind') w", "WHERE zone = 'view') w"))
def daily_summary(t: Tables):
    prices, _ = hourly_prices(t)
    five = _five(t)
    name = F.when(F.col("zone") == "view", "Wind").when(F.col("zone") == "click", "Hydro").when(F.col("zone") == "error", "Nuclear").otherwise(F.col("zone"))
    fuel = five.select("ts_utc", name.alias("fuel"), F.col("load_mw").alias("gen_mw"), "covered_s")
    system = derived.system_5m(derived.with_system_total(five), fuel, five.withColumnRenamed("load_mw", "lbmp"))
    return rounded(derived.daily_summary(system, prices, fuel))


@check("local_day_hours", f"""WITH {SHIFTED_SQL}, l AS (SELECT {LOCAL.format('ts_utc')} AS ts_local, ts_utc FROM ev), g AS (
SELECT CAST(ts_local AS DATE) AS day, count(*) AS n, count(DISTINCT date_trunc('hour', ts_utc)) AS utc_hours, count(DISTINCT hour(ts_local)) AS local_hours FROM l GROUP BY 1)
SELECT day, n, utc_hours, local_hours, CAST((epoch(timezone('America/New_York', CAST(day + 1 AS TIMESTAMP))) - epoch(timezone('America/New_York', CAST(day AS TIMESTAMP)))) / 3600 AS INTEGER) AS day_hours,
CAST(0 AS BIGINT) AS not_recovered FROM g""")
def local_day_hours(t: Tables):
    """UTC -> local -> UTC with the standard-time flag recovers every stamp, also in the repeated hour."""
    s = t.shifted().withColumn("ts_local", clock.to_local(F.col("ts_utc")))
    earlier = F.from_utc_timestamp(F.col("ts_utc") - F.expr("INTERVAL 1 HOUR"), "America/New_York").cast("timestamp_ntz")
    back = clock.local_to_utc(F.col("ts_local"), standard=earlier == F.col("ts_local"))
    g = s.withColumn("_bad", (back != F.col("ts_utc")).cast("bigint")).groupBy(F.to_date("ts_local").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.date_trunc("hour", "ts_utc")).alias("utc_hours"), F.count_distinct(F.hour("ts_local")).alias("local_hours"),
        F.sum("_bad").alias("not_recovered"))
    return g.withColumn("day_hours", clock.hours_in_day(F.col("day")))


@check("issue_and_bounds", f"""SELECT DISTINCT CAST(l_shipdate AS DATE) AS d, timezone('UTC', timezone('America/New_York', CAST(CAST(l_shipdate AS DATE) - 1 AS TIMESTAMP) + INTERVAL 5 HOUR)) AS issue_utc,
timezone('UTC', timezone('America/New_York', CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP))) AS day_start, timezone('UTC', timezone('America/New_York', CAST(CAST(l_shipdate AS DATE) + 1 AS TIMESTAMP))) AS day_end FROM lineitem""")
def issue_and_bounds(t: Tables):
    d = t.lineitem.select(F.to_date("l_shipdate").alias("d")).distinct()
    return rounded(d.select("d", clock.issue_time(F.col("d")).alias("issue_utc"), clock.local_midnight(F.col("d")).alias("day_start"),
                            clock.local_midnight(F.date_add("d", 1)).alias("day_end")))


HOLIDAYS_SQL = """hol AS (SELECT d FROM (
  SELECT CASE WHEN isodow(d) = 7 THEN d + 1 ELSE d END AS d FROM (SELECT make_date(y, 1, 1) AS d FROM yrs UNION ALL SELECT make_date(y, 7, 4) FROM yrs UNION ALL SELECT make_date(y, 12, 25) FROM yrs)
  UNION ALL SELECT max(d) FROM dd WHERE month(d) = 5 AND isodow(d) = 1 GROUP BY year(d)
  UNION ALL SELECT min(d) FROM dd WHERE month(d) = 9 AND isodow(d) = 1 GROUP BY year(d)
  UNION ALL SELECT min(d) + 21 FROM dd WHERE month(d) = 11 AND isodow(d) = 4 GROUP BY year(d)))"""
YEARS_SQL = """yrs AS (SELECT CAST(unnest(range(1994, 2004)) AS INTEGER) AS y), dd AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2003-12-31', INTERVAL 1 DAY)) AS DATE) AS d)"""


@check("calendar_features", f"""WITH {YEARS_SQL}, {HOLIDAYS_SQL}, days AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)
SELECT d, n, CAST(isodow(d) AS INTEGER) AS dow, CAST(month(d) AS INTEGER) AS month, isodow(d) >= 6 AS is_weekend, d IN (SELECT d FROM hol) AS is_holiday,
round(sin(2 * pi() * dayofyear(d) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(d) / 365.25), 6) AS doy_cos FROM days""")
def calendar_features(t: Tables):
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    cols = calendar_columns(F.col("d")) | {"is_holiday": is_holiday(F.col("d"), 1994, 2003)}
    return rounded(days.withColumns(cols))


@check("peak_periods", f"""WITH {YEARS_SQL.replace('1994', '2023').replace('2004', '2026').replace('2003', '2025')}, {HOLIDAYS_SQL}, {SHIFTED_SQL}, l AS (SELECT {LOCAL.format('ts_utc')} AS tl, value FROM ev)
SELECT date_trunc('month', tl)::DATE AS month, CASE WHEN isodow(tl) < 6 AND hour(tl) BETWEEN 7 AND 22 AND CAST(tl AS DATE) NOT IN (SELECT d FROM hol) THEN 'peak' ELSE 'offpeak' END AS period,
count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM l GROUP BY 1, 2""")
def peak_periods(t: Tables):
    tl = clock.to_local(F.col("ts_utc"))
    s = t.shifted().withColumn("tl", tl)
    return s.groupBy(F.trunc(F.to_date("tl"), "MM").alias("month"), peak_period(F.col("tl"), is_holiday(F.to_date("tl"))).alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@check("degree_and_ratio", """SELECT p_brand, count(*) AS n, round(sum(greatest(0, 18.3 - p_size)), 6) AS hdh, round(sum(greatest(0, p_size - 18.3)), 6) AS cdh,
count(p_retailprice / nullif(p_size - 10, 0)) AS n_ratio, round(avg(p_retailprice / nullif(p_size - 10, 0)), 6) AS ratio FROM part GROUP BY 1""")
def degree_and_ratio(t: Tables):
    heat, cool = degree_hours(F.col("p_size").cast("double"))
    ratio = safe_ratio(F.col("p_retailprice"), (F.col("p_size") - 10).cast("double"))
    return rounded(t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum(heat).alias("hdh"), F.sum(cool).alias("cdh"), F.count(ratio).alias("n_ratio"), F.avg(ratio).alias("ratio")))


@check("snapshot_runs", """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS s FROM (SELECT DISTINCT user_id, ts FROM events)),
g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM f), c AS (SELECT user_id, ts, count(*) AS k FROM events GROUP BY 1, 2)
SELECT user_id, min(ts) AS first_seen_utc, max(ts) AS last_seen_utc, CAST(sum(k) AS BIGINT) AS snapshots FROM g JOIN c USING (user_id, ts) GROUP BY user_id, run""")
def snapshot_runs(t: Tables):
    return rounded(compact_snapshots(t.events, ["user_id"], "ts", 900))


@check("event_row_numbers", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS row_no FROM events")
def event_row_numbers(t: Tables):
    return row_index(t.events.select("event_id", "event_type", "ts"), ["event_type"], "ts", ["event_id"]).select("event_id", "row_no")


@check("keep_last_order", """SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, o_orderdate FROM (
SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def keep_last_order(t: Tables):
    cols = ["o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", "o_orderdate"]
    return rounded(keep_last(t.orders.select(*cols), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]), 2)


@check("exact_quantiles", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS q05, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.95), 6) AS q95,
round(quantile_cont(l_extendedprice, 0.999), 6) AS q999 FROM lineitem GROUP BY 1""")
def quantiles(t: Tables):
    return rounded(exact_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95, 0.999], names=["q05", "q50", "q95", "q999"]))


COVERAGE_SQL = f"""{SHIFTED_SQL}, b AS (SELECT CAST({LOCAL.format('ts_utc')} AS DATE) AS day, time_bucket(INTERVAL 60 MINUTE, ts_utc + INTERVAL 1800 SECOND) AS t, zone FROM ev),
seen AS (SELECT day, count(DISTINCT t) AS intervals, count(DISTINCT zone) AS entities, count(*) AS rows FROM b GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(day) AS TIMESTAMP) FROM seen), (SELECT CAST(max(day) AS TIMESTAMP) FROM seen), INTERVAL 1 DAY)) AS DATE) AS day),
cov AS (SELECT day, coalesce(intervals, 0) AS intervals, coalesce(entities, 0) AS entities, coalesce(rows, 0) AS rows,
CAST((epoch(timezone('America/New_York', CAST(day + 1 AS TIMESTAMP))) - epoch(timezone('America/New_York', CAST(day AS TIMESTAMP)))) / 3600 AS BIGINT) AS expected FROM cal LEFT JOIN seen USING (day))"""


@check("coverage_audit", f"WITH {COVERAGE_SQL} SELECT *, round(least(intervals / expected, 1.0), 6) AS coverage FROM cov")
def coverage_audit(t: Tables):
    return rounded(audit.coverage(t.shifted(), ["zone"], 60))


@check("coverage_summary", f"""WITH {COVERAGE_SQL} SELECT 'events' AS dataset, count(*) AS days, round(avg(least(intervals / expected, 1.0)), 6) AS coverage,
count(*) FILTER (least(intervals / expected, 1.0) < 0.99) AS bad_days FROM cov""")
def coverage_summary(t: Tables):
    return rounded(audit.coverage_summary(audit.coverage(t.shifted(), ["zone"], 60).withColumn("dataset", F.lit("events")), ["dataset"]))


@check("duplicate_keys", "SELECT count(*) AS duplicate_keys FROM (SELECT o_custkey, o_orderpriority FROM orders GROUP BY 1, 2 HAVING count(*) > 1)")
def duplicate_keys(t: Tables):
    return audit.duplicate_keys(t.orders, ["o_custkey", "o_orderpriority"])


@check("table_stats", """SELECT 'events' AS table_name, count(*) AS rows, strftime(min(ts)::DATE, '%Y-%m-%d') AS first, strftime(max(ts)::DATE, '%Y-%m-%d') AS last FROM events
UNION ALL SELECT 'orders', count(*), strftime(min(o_orderdate)::DATE, '%Y-%m-%d'), strftime(max(o_orderdate)::DATE, '%Y-%m-%d') FROM orders
UNION ALL SELECT 'lineitem', count(*), strftime(min(l_shipdate)::DATE, '%Y-%m-%d'), strftime(max(l_shipdate)::DATE, '%Y-%m-%d') FROM lineitem""")
def table_stats(t: Tables):
    return audit.table_stats({"events": (t.events.withColumn("ts", F.to_date("ts")), "ts"), "orders": (t.orders.withColumn("o_orderdate", F.to_date("o_orderdate")), "o_orderdate"),
                              "lineitem": (t.lineitem.withColumn("l_shipdate", F.to_date("l_shipdate")), "l_shipdate")})


@check("vintage_filter", """SELECT CAST(l_shipdate AS DATE) AS d, o_orderpriority AS zone, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE CAST(o_orderdate AS DATE) = CAST(timezone('America/New_York', timezone('UTC', l_shipdate + INTERVAL 12 HOUR)) AS DATE) - 1 GROUP BY 1, 2""")
def vintage_filter(t: Tables):
    l = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lf = l.select((F.col("l_shipdate") + F.expr("INTERVAL 12 HOUR")).alias("ts_utc"), F.col("o_orderpriority").alias("zone"), F.to_date("o_orderdate").alias("issue_date"),
                  F.col("l_quantity").alias("load_forecast_mw"))
    return derived.day_ahead_load_forecast(lf).groupBy(F.to_date("ts_utc").alias("d"), "zone").agg(F.count(F.lit(1)).alias("n"))


def _constraints(t: Tables):
    da = t.lineitem.select(F.col("l_shipdate").alias("ts_local"), F.col("l_returnflag").alias("facility"), F.col("l_linestatus").alias("contingency"),
                           (F.col("l_extendedprice") - 30000).cast("decimal(18,2)").alias("shadow_price"))
    rt = t.orders.select(F.col("o_orderdate").alias("ts_local"), F.col("o_orderstatus").alias("facility"), F.col("o_orderpriority").alias("contingency"),
                         (F.col("o_totalprice") - 250000).cast("decimal(18,2)").alias("shadow_price"))
    return da, rt


CON_SQL = """dac AS (SELECT l_shipdate AS ts_local, l_returnflag AS facility, l_linestatus AS contingency, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - 30000 AS DECIMAL(18,2)) AS sp FROM lineitem),
rtc AS (SELECT o_orderdate AS ts_local, o_orderstatus AS facility, o_orderpriority AS contingency, CAST(CAST(o_totalprice AS DECIMAL(18,2)) - 250000 AS DECIMAL(18,2)) AS sp FROM orders)"""


@check("constraints_daily", f"""WITH {CON_SQL}, u AS (SELECT 'DA' AS market, 1.0 AS h, * FROM dac UNION ALL SELECT 'RT', 5 / 60, * FROM rtc)
SELECT market, CAST(ts_local AS DATE) AS day, facility, contingency, count(*) AS intervals, round(count(*) * max(h)::DOUBLE, 6) AS hours_binding, CAST(sum(sp) AS DOUBLE) AS sum_cost,
CAST(max(abs(sp)) AS DOUBLE) AS max_abs_cost, round(CAST(sum(sp) AS DOUBLE) / count(*), 6) AS avg_cost FROM u GROUP BY ALL""".replace("5 / 60", "5 / 60::DOUBLE").replace("1.0 AS h", "1::DOUBLE AS h"))
def constraints_daily(t: Tables):
    da, rt = _constraints(t)
    out = derived.constraints_daily(da, rt)
    return rounded(out.withColumns({"sum_cost": F.col("sum_cost").cast("double"), "max_abs_cost": F.col("max_abs_cost").cast("double"),
                                    "avg_cost": F.round(F.col("sum_cost").cast("double") / F.col("intervals"), 6)}))


@check("shadow_prices", f"""WITH {CON_SQL}, a AS (SELECT ts_local, facility || ' | ' || contingency AS key, CAST(sum(sp) AS DOUBLE) AS s FROM dac GROUP BY 1, 2)
SELECT 'da' AS market, CAST(ts_local AS DATE) AS d, CAST(hour(ts_local) AS INTEGER) AS hr, key, round(avg(s), 4) AS mu FROM a GROUP BY ALL HAVING avg(s) <> 0
UNION ALL SELECT 'rt', CAST(ts_local AS DATE), CAST(hour(ts_local) AS INTEGER), facility || ' | ' || contingency, round(CAST(sum(sp) AS DOUBLE) * 5 / 60, 4) FROM rtc GROUP BY ALL HAVING sum(sp) <> 0""")
def shadow_prices(t: Tables):
    da, rt = _constraints(t)
    s = derived.shadow_prices(da.withColumn("shadow_price", F.col("shadow_price")), rt)
    return s.withColumn("mu", F.round(F.col("mu").cast("double"), 4))


@check("backfill_plan", """WITH w AS (SELECT key, m FROM (SELECT unnest(['orders', 'lineitem']) AS key), (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS m)),
man AS (SELECT 'orders' AS key, date_trunc('month', o_orderdate)::DATE AS m, max(o_orderdate)::DATE + 2 AS wr FROM orders GROUP BY 1, 2
UNION ALL SELECT 'lineitem', date_trunc('month', l_shipdate)::DATE, max(l_shipdate)::DATE + 3 FROM lineitem GROUP BY 1, 2)
SELECT key, m AS month FROM w WHERE NOT EXISTS (SELECT 1 FROM man WHERE man.key = w.key AND man.m = w.m AND man.m <> DATE '2001-08-01' AND man.wr >= last_day(man.m) + 2)""")
def backfill_plan(t: Tables):
    wanted = warehouse.wanted_months(t.spark, ["orders", "lineitem"], date(1995, 1, 1), date(2001, 12, 1))
    o = t.orders.groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.date_add(F.max(F.to_date("o_orderdate")), 2).alias("written_at")).withColumn("key", F.lit("orders"))
    l = t.lineitem.groupBy(F.trunc("l_shipdate", "MM").alias("month")).agg(F.date_add(F.max(F.to_date("l_shipdate")), 3).alias("written_at")).withColumn("key", F.lit("lineitem"))
    return warehouse.backfill_plan(wanted, o.unionByName(l), date(2001, 8, 15))


@check("station_observations", """WITH r AS (SELECT event_type AS station, ts, value, CASE WHEN value BETWEEN -45 AND 45 THEN value END AS t, CASE WHEN value - 30 BETWEEN -60 AND 35 THEN value - 30 END AS d,
CASE WHEN value / 4 BETWEEN 0 AND 60 THEN value / 4 END AS w FROM events),
h AS (SELECT station, t, d, w, time_bucket(INTERVAL 1 HOUR, ts + INTERVAL 30 MINUTE) AS ts_utc FROM r WHERE coalesce(t, d, w) IS NOT NULL)
SELECT ts_utc, station, round(avg(t), 6) AS temp_c, round(avg(d), 6) AS dewpoint_c, round(avg(w), 6) AS wind_ms, count(*) AS n_reports, ts_utc + INTERVAL 30 MINUTE AS available_utc FROM h GROUP BY 1, 2""")
def station_observations(t: Tables):
    raw = t.events.select(F.col("event_type").alias("station"), F.col("ts").cast("string").alias("DATE"), F.col("value").cast("string").alias("temperature"),
                          (F.col("value") - 30).cast("string").alias("dew_point_temperature"), (F.col("value") / 4).cast("string").alias("wind_speed"))
    return rounded(external.weather_observations(raw))


@check("forecast_vintages", """WITH w AS (SELECT event_type AS station, date_trunc('hour', ts) AS ts_utc, round(avg(value), 4) AS v0, round(min(value), 4) AS v1, round(max(value), 4) AS v2 FROM events GROUP BY 1, 2)
SELECT ts_utc, station, 0 AS lead_days, v0 AS temp_c, ts_utc + INTERVAL 6 HOUR AS available_utc FROM w
UNION ALL SELECT ts_utc, station, 1, v1, ts_utc - INTERVAL 18 HOUR FROM w UNION ALL SELECT ts_utc, station, 2, v2, ts_utc - INTERVAL 42 HOUR FROM w""")
def forecast_vintages(t: Tables):
    w = t.events.groupBy(F.col("event_type").alias("station"), F.date_trunc("hour", "ts").alias("ts_utc")).agg(
        F.round(F.avg("value"), 4).alias("temperature_2m"), F.round(F.min("value"), 4).alias("temperature_2m_previous_day1"), F.round(F.max("value"), 4).alias("temperature_2m_previous_day2"))
    return rounded(external.forecast_vintages(w))


@check("gas_price_availability", f"""WITH {BOOK_SQL} SELECT d AS trade_date, round(avg(da), 6) AS price_usd_mmbtu, timezone('UTC', timezone('America/New_York', CAST(d + 1 AS TIMESTAMP))) AS available_utc FROM book GROUP BY 1""")
def gas_price(t: Tables):
    raw = t.book().groupBy(F.col("d").alias("trade_date")).agg(F.round(F.avg("da"), 6).alias("price_usd_mmbtu"))
    return rounded(external.gas_prices(raw))


@check("grid_to_zones", """WITH c AS (SELECT date_trunc('day', l_shipdate) + INTERVAL 6 HOUR AS run_utc, CAST(l_linenumber AS INTEGER) + 20 AS lead_h, l_suppkey % 10 AS zone, l_extendedprice / 997 AS t, l_quantity AS u, l_discount * 100 AS v, l_tax * 1000 AS r FROM lineitem)
SELECT run_utc + to_hours(lead_h) AS ts_utc, 'z' || zone AS zone, run_utc, lead_h, round(avg(t - 273.15), 6) AS temp_c, round(avg(t - 280), 6) AS dewpoint_c, round(avg(sqrt(u * u + v * v)), 6) AS wind80_ms,
round(avg(u), 6) AS cloud_pct, round(quantile_cont(t, 0.9), 6) AS cape_p90, round(avg(CASE WHEN r >= 40 THEN 1.0 ELSE 0.0 END), 6) AS refl40_share, round(avg(v), 6) AS lightning_density, run_utc + INTERVAL 2 HOUR AS available_utc
FROM c WHERE CAST(timezone('America/New_York', timezone('UTC', run_utc + to_hours(lead_h))) AS DATE) = CAST(run_utc AS DATE) + 1 GROUP BY run_utc, lead_h, zone""")
def grid_to_zones(t: Tables):
    l = t.lineitem
    cells = l.select((F.date_trunc("day", "l_shipdate") + F.expr("INTERVAL 6 HOUR")).alias("run_utc"), (F.col("l_linenumber") + 20).alias("lead_h"), F.col("l_suppkey").alias("iy"), F.lit(0).alias("ix"),
                     (F.col("l_extendedprice") / 997).alias("tmp2m"), (F.col("l_extendedprice") / 997 - 6.85).alias("dpt2m"), F.col("l_quantity").alias("u80"), (F.col("l_discount") * 100).alias("v80"),
                     F.col("l_quantity").alias("tcdc"), (F.col("l_extendedprice") / 997).alias("cape"), (F.col("l_tax") * 1000).alias("refc"), (F.col("l_discount") * 100).alias("ltng"))
    zones = t.supplier.select(F.concat(F.lit("z"), F.col("s_suppkey") % 10).alias("zone"), F.col("s_suppkey").alias("iy"), F.lit(0).alias("ix"))
    return rounded(external.zone_forecast(cells, zones))


@check("tidy_values", "SELECT l_returnflag, l_linestatus, round(avg(l_discount), 2) AS avg_disc, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS avg_price FROM lineitem GROUP BY 1, 2")
def tidy_values(t: Tables):
    from wattline.plans.views import tidy

    g = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("avg_disc"), (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("avg_price"))
    return tidy(g)
