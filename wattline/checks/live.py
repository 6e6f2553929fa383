"""Live views, node tables and small rules on the book, each over all its days."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from wattline.checks.base import BOOK_SQL, LOCAL, PRED_SQL, SHIFTED_SQL, Tables, check, rounded
from wattline.functions.clock import hours_between_days
from wattline.functions.numeric import destabilise, price_components, stabilise
from wattline.operators.reshape import time_by_node
from wattline.plans import derived, views
from wattline.session import checkpoint_dir
from wattline.sources import warehouse

# per row of the book: hourly prices at the day's start; forecasts of yesterday's price, five either side; positions by the sign of the forecast spread
POSITION_SQL = f"""{PRED_SQL}, fc AS (SELECT d, zone, market, mean FROM pred WHERE trial = 'm1' AND mean IS NOT NULL),
pos AS (SELECT a.d, a.zone, a.mean - b.mean AS s, CASE WHEN a.mean > b.mean + 1 THEN 1.0 WHEN a.mean < b.mean - 1 THEN -1.0 ELSE 0.5 END AS x FROM fc a JOIN (SELECT d, zone, mean FROM pred WHERE trial = 'm2' AND market = 'rt') b USING (d, zone) WHERE a.market = 'da'),
w AS (SELECT pos.*, da, CASE WHEN day(pos.d) <= 25 THEN rt END AS rt FROM pos JOIN book USING (d, zone))"""


def _hourly(t: Tables, settled: int = 31):
    rt = F.when(F.day("d") <= settled, F.col("rt"))
    return t.book().select("zone", F.col("d").cast("timestamp").alias("ts_utc"), F.col("da").alias("da_lbmp"), rt.alias("rt_lbmp"), (F.col("da") / 10).alias("da_mcc"), (F.col("rt") / 10).alias("rt_mcc"))


def _forecasts(t: Tables, trial: str = "m1"):
    p = t.predictions().where((F.col("trial") == trial) & F.col("mean").isNotNull())
    return p.select("delivery_date", "ts_utc", "zone", "hour_local", "market", "component", "mean", (F.col("mean") - 5).alias("q05"), (F.col("mean") + 5).alias("q95"))


def _positions(t: Tables):
    a = _forecasts(t).where("market = 'da'").select("delivery_date", "ts_utc", "zone", "hour_local", F.col("mean").alias("_a"))
    b = _forecasts(t, "m2").where("market = 'rt'").select("delivery_date", "zone", F.col("mean").alias("_b"))
    j = a.join(b, ["delivery_date", "zone"])
    x = F.when(F.col("_a") > F.col("_b") + 1, 1.0).when(F.col("_a") < F.col("_b") - 1, -1.0).otherwise(0.5)
    return j.withColumns({"spread_fcst": F.col("_a") - F.col("_b"), "x_mw": x, "p_spike": F.lit(0.1)})


@check("live_track_record", f"""WITH {PRED_SQL} SELECT d AS delivery_date, market, count(*) AS n, round(avg(abs(mean - y)), 6) AS mae, round(avg(CASE WHEN y BETWEEN mean - 5 AND mean + 5 THEN 1.0 ELSE 0.0 END), 6) AS cov90
FROM pred WHERE trial = 'm1' AND mean IS NOT NULL AND d >= DATE '1992-06-01' GROUP BY 1, 2""")
def live_track_record(t: Tables):
    return rounded(views.live_track(_forecasts(t), _hourly(t), date(1992, 6, 1)))


@check("live_paper_days", f"""WITH {POSITION_SQL}, g AS (SELECT d, sum(abs(x)) AS mwh, sum(x * (da - rt) - {views.TRADE_COST} * abs(x)) AS pnl, count(rt) AS k, count(*) AS n FROM w GROUP BY 1)
SELECT d AS delivery_date, round(mwh, 4) AS mwh, round(pnl + 1e-9, 4) AS pnl, round(sum(pnl) OVER (ORDER BY d) + 1e-9, 3) AS cum_pnl FROM g WHERE k = n""")
def live_paper_days(t: Tables):
    """Paper profit of the days that are settled in full, summed up."""
    p = views.live_paper(_positions(t), _hourly(t, 25))
    return rounded(p.select("delivery_date", "mwh", (F.col("pnl") + 1e-9).alias("pnl"), F.round(F.col("cum_pnl") + 1e-9, 3).alias("cum_pnl")), 4)


@check("dart_day_summary", f"""WITH {POSITION_SQL}, l AS (SELECT * FROM w WHERE d = (SELECT max(d) FROM w))
SELECT zone, round(sum(x), 4) AS net_mwh, round(sum(abs(x)), 4) AS gross_mwh, round(avg(s), 4) AS spread_fcst, round(avg(da - rt), 4) AS spread_actual, round(sum(x * (da - rt) - {views.TRADE_COST} * abs(x)), 4) AS pnl, count(rt) AS settled_hours, count(*) AS hours FROM l GROUP BY 1""")
def dart_day_summary(t: Tables):
    out = views.live_positions(_positions(t), _hourly(t, 25))
    return rounded(out.drop("p_spike_max", "p_spike_hour"), 4)


@check("node_day_average", """WITH n AS (SELECT l_suppkey % 60 AS ptid, CAST(l_shipdate AS DATE) AS d, l_linenumber AS h, avg(l_quantity) AS total FROM lineitem GROUP BY 1, 2, 3), m AS (SELECT max(d) AS d FROM n)
SELECT ptid, 'N' || ptid AS name, 'z' || (ptid % 5) AS zone, ptid / 2.0 AS lat, round(-ptid / 3.0, 4) AS lon, round(avg(total), 4) AS total, round(avg(total / 4), 4) AS congestion FROM n JOIN m USING (d) WHERE ptid % 7 <> 0 GROUP BY ptid""")
def node_day_average(t: Tables):
    f = t.lineitem.groupBy((F.col("l_suppkey") % 60).alias("ptid"), F.to_date("l_shipdate").alias("delivery_date"), "l_linenumber").agg(F.avg("l_quantity").alias("total"))
    f = f.withColumns({"congestion": F.col("total") / 4, "market": F.lit("da"), "zone": F.concat(F.lit("z"), F.col("ptid") % 5)})
    nodes = t.lineitem.select((F.col("l_suppkey") % 60).alias("ptid")).distinct().withColumns(
        {"name": F.concat(F.lit("N"), "ptid"), "lat": F.when(F.col("ptid") % 7 != 0, F.col("ptid") / 2.0), "lon": -F.col("ptid") / 3.0})
    return rounded(views.live_nodes(f, nodes).withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double")}), 4)


CONG_SQL = f"""{SHIFTED_SQL}, pr AS (SELECT {LOCAL.format("date_trunc('hour', ts_utc)")} AS ts_local, date_trunc('hour', ts_utc) AS ts_utc, user_id % 30 AS ptid, avg(value) AS mcc FROM ev GROUP BY ALL)"""


def _node_prices(t: Tables):
    hour = F.date_trunc("hour", "ts_utc")
    return t.shifted().groupBy(hour.alias("ts_utc"), (F.col("user_id") % 30).alias("ptid")).agg(F.avg("value").alias("mcc")).withColumn("ts_local", F.from_utc_timestamp("ts_utc", "America/New_York"))


@check("node_congestion_matrix", f"""WITH {CONG_SQL} SELECT CAST(ts_local AS DATE) AS d, CAST(hour(ts_local) AS INTEGER) AS hr, ptid, round(avg(-mcc), 6) AS cong FROM pr GROUP BY 1, 2, 3""")
def node_congestion_matrix(t: Tables):
    """Hourly node prices over the autumn clock change: the repeated hour is one slot."""
    return rounded(derived.node_congestion(_node_prices(t)))


@check("path_congestion_frame", f"""WITH {CONG_SQL} SELECT ts_utc, ptid, round(avg(-mcc), 6) AS cong FROM (SELECT ts_utc, ptid, mcc FROM pr UNION ALL SELECT ts_utc, ptid, mcc + 1 FROM pr WHERE ptid < 5) GROUP BY 1, 2""")
def path_congestion_frame(t: Tables):
    n = _node_prices(t)
    return rounded(derived.point_congestion(n.where("ptid < 5").withColumn("mcc", F.col("mcc") + 1), n))


@check("times_by_nodes", f"""WITH {CONG_SQL}, c AS (SELECT ts_utc, ptid, floor(avg(mcc) * 100) / 100 AS v FROM pr GROUP BY 1, 2) SELECT ts_utc, count(*) AS nodes, min(ptid) AS first_node, round(sum(v), 4) AS total FROM c GROUP BY 1""")
def times_by_nodes(t: Tables):
    m = time_by_node(_node_prices(t).groupBy("ts_utc", "ptid").agg((F.floor(F.avg("mcc") * 100) / 100).alias("v")), "ts_utc", "ptid", "v")
    return rounded(m.select("ts_utc", F.size("values").cast("long").alias("nodes"), F.array_min(F.map_keys("values")).alias("first_node"), F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, v: a + v).alias("total")), 4)


@check("components_and_transform", """WITH x AS (SELECT l_returnflag AS g, l_orderkey AS k, l_linenumber AS i, l_extendedprice / 1000 AS p, l_discount * 10 AS l, l_tax * 10 - 0.3 AS c FROM lineitem), m AS (SELECT g, avg(p) AS mu, stddev_pop(p) AS sd FROM x GROUP BY 1)
SELECT k, i, round(p - l + c, 6) AS energy, round(l, 6) AS loss, round(-c, 6) AS congestion, round(p, 6) AS total, round(ln((p - mu) / sd + sqrt(((p - mu) / sd) * ((p - mu) / sd) + 1)), 6) AS z, round(p, 6) AS back FROM x JOIN m USING (g)""")
def components_and_transform(t: Tables):
    """Published price, loss and congestion split into parts that add up; the stabilising transform and its inverse."""
    x = t.lineitem.select("l_returnflag", F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_extendedprice").cast("double") / 1000).alias("p"), (F.col("l_discount").cast("double") * 10).alias("l"),
                          (F.col("l_tax").cast("double") * 10 - 0.3).alias("c"))
    m = x.groupBy("l_returnflag").agg(F.avg("p").alias("mu"), F.stddev_pop("p").alias("sd"))
    z = stabilise(F.col("p"), F.col("mu"), F.col("sd"))
    m = F.broadcast(m)                                   # a row a flag; else each flag's lines are one task's
    return rounded(x.join(m, "l_returnflag").select("k", "i", *[c.alias(n) for n, c in price_components("p", "l", "c").items()], z.alias("z"), destabilise(z, F.col("mu"), F.col("sd")).alias("back")))


@check("period_hours", """WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) AS b FROM orders)
SELECT o_orderkey, CAST((epoch(timezone('America/New_York', CAST(b + 1 AS TIMESTAMP))) - epoch(timezone('America/New_York', CAST(a AS TIMESTAMP)))) / 3600 AS BIGINT) AS hours FROM p""")
def period_hours(t: Tables):
    a = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", hours_between_days(a, F.date_add(a, (F.col("o_orderkey") % 400).cast("int"))).alias("hours"))


@check("month_partitions", f"""WITH {SHIFTED_SQL} SELECT year({LOCAL.format('ts_utc')}) AS year, month({LOCAL.format('ts_utc')}) AS month, count(*) AS n, round(sum(value), 2) AS total FROM ev GROUP BY 1, 2""")
def month_partitions(t: Tables):
    """Rows stored under their local month, one month written twice, read back with a column that no file has."""
    path = f"{checkpoint_dir(t.spark)}/months-{uuid.uuid4().hex}"
    s = t.shifted().select("ts_utc", "zone", "value", "event_id")
    warehouse.write_by_local_month(s, path, "ts_utc")
    first = s.agg(F.min("ts_utc")).first()[0]
    month = F.trunc(F.to_date(F.from_utc_timestamp("ts_utc", "America/New_York")), "MM")
    again = s.where(month == s.where(F.col("ts_utc") == F.lit(first)).select(month).first()[0])
    warehouse.write_by_local_month(again, path, "ts_utc", files_per_month=4)
    out = t.spark.read.parquet(path).groupBy(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out
