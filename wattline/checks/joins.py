"""As-of, range, overlap and validity joins, lags, set operations, reshaping, top-k, names and areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.checks.base import BOOK_SQL, LAGGED_SQL, PRED_SQL, Tables, check, parents, rounded
from wattline.functions import names
from wattline.models.congestion import name_match
from wattline.operators.asof import asof_few, asof_long
from wattline.operators.intervals import expected_out, known_and_overlapping, listed_outages, overlap_join, point_in_span_join, window_stats
from wattline.operators.ordered import top_per_group
from wattline.operators.reshape import calendar_lag, latest_union, markets_wide, pivot_values, running, targets_long
from wattline.operators.scoring import melt_scores, with_total
from wattline.plans.derived import prefer_published
from wattline.plans.views import at_latest, mappable_nodes
from wattline.sources.geography import flag_priced, points_in_polygons, reference_report


@check("asof_last_click", """SELECT e.event_id, e.user_id, e.ts AS ts, c.ts AS click_ts, c.value FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof_last_click(t: Tables):
    clicks = t.events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), "value")
    errors = t.events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return rounded(asof_long(errors, clicks, ["user_id"], "ts", "click_ts", ["value"]))


@check("asof_last_order", """SELECT l_orderkey, l_linenumber, c.o_custkey, o_orderkey, o_orderdate FROM (SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) c
LEFT JOIN LATERAL (SELECT o_orderkey, o_orderdate FROM orders o WHERE o.o_custkey = c.o_custkey AND o.o_orderdate <= c.l_shipdate ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true""")
def asof_last_order(t: Tables):
    """The customer's latest order at or before each shipment; ties on the day go to the larger key."""
    ship = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_shipdate", "o_custkey")
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    out = asof_long(ship, orders, ["o_custkey"], "l_shipdate", "o_orderdate", ["o_orderkey"], tie=["o_orderkey"], how="left", chunk=30 * 86400)
    return rounded(out.select("l_orderkey", "l_linenumber", "o_custkey", "o_orderkey", "o_orderdate"))


def _asof_vintage_sql(anchor: str) -> str:
    return f"""SELECT o_orderkey, anchor, l_shipdate AS shipped, l_linenumber, l_extendedprice FROM (SELECT o_orderkey, o_orderdate + INTERVAL {anchor} DAY AS anchor, l_shipdate, l_linenumber, l_extendedprice,
row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_extendedprice DESC) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate <= o_orderdate + INTERVAL {anchor} DAY) WHERE r = 1"""


def _asof_vintage(t: Tables, days: int):
    left = t.orders.select("o_orderkey", (F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAY")).alias("anchor"))
    right = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("shipped"), "l_linenumber", "l_extendedprice")
    return rounded(asof_few(left, right, ["o_orderkey"], "anchor", "shipped", ["l_linenumber", "l_extendedprice"], tie=["l_linenumber", "l_extendedprice"]))


@check("asof_vintages", _asof_vintage_sql("60"))
def asof_vintages(t: Tables):
    return _asof_vintage(t, 60)


@check("asof_second_anchor", _asof_vintage_sql("30"))
def asof_second_anchor(t: Tables):
    """The same vintages as known at an earlier anchor."""
    return _asof_vintage(t, 30)


@check("calendar_lags", f"WITH {LAGGED_SQL} SELECT d, zone, da, da_l1, da_l2, da_l7, rt_l2 FROM lagged")
def calendar_lags(t: Tables):
    b = t.book()
    out = b.select("d", "zone", "da")
    for k in (1, 2, 7):
        out = out.join(calendar_lag(b, ["zone"], "d", k, ["da", "rt"], f"_l{k}"), ["zone", "d"], "left")
    return out.select("d", "zone", "da", "da_l1", "da_l2", "da_l7", "rt_l2")


@check("lookback_window_stats", """WITH a AS (SELECT DISTINCT event_type, date_trunc('day', ts) + INTERVAL 10 HOUR AS anchor FROM events)
SELECT a.event_type, anchor, max(value) FILTER (ts >= anchor - INTERVAL 24 HOUR) AS recent_max, round(avg(value) FILTER (ts >= anchor - INTERVAL 24 HOUR), 6) AS recent_mean,
count(*) FILTER (value > 50 OR value - 20 > 50) AS shortage, max(ts) + INTERVAL 20 MINUTE AS avail FROM a JOIN events e ON e.event_type = a.event_type AND ts >= anchor - INTERVAL 7 DAY AND ts + INTERVAL 20 MINUTE <= anchor GROUP BY 1, 2""")
def lookback_window_stats(t: Tables):
    e = t.events.select("event_type", "ts", "value", (F.col("value") - 20).alias("alt"))
    a = e.select("event_type", (F.date_trunc("day", "ts") + F.expr("INTERVAL 10 HOUR")).alias("anchor")).distinct()
    return rounded(window_stats(e, a, ["event_type"], "ts", "anchor", "value", "alt"))


@check("overlapping_spans", """WITH a AS (SELECT user_id, event_id AS a_id, ts AS s, ts + INTERVAL 6 HOUR AS e FROM events WHERE event_type = 'error'),
b AS (SELECT user_id, event_id AS b_id, ts AS s, ts + INTERVAL 9 HOUR AS e FROM events WHERE event_type = 'click')
SELECT a.user_id, a_id, b_id FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e""")
def overlapping_spans(t: Tables):
    span = lambda kind, h, tag: t.events.filter(F.col("event_type") == kind).select(                     # noqa: E731
        "user_id", F.col("event_id").alias(f"{tag}_id"), F.col("ts").alias(f"{tag}_s"), (F.col("ts") + F.expr(f"INTERVAL {h} HOUR")).alias(f"{tag}_e"))
    return overlap_join(span("error", 6, "a"), span("click", 9, "b"), ["user_id"], ("a_s", "a_e"), ("b_s", "b_e"), bucket=6 * 3600).select("user_id", "a_id", "b_id")


@check("points_in_spans", """WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate AS s, o_orderdate + INTERVAL 7 DAY AS e FROM orders)
SELECT o.o_custkey, s.o_orderkey AS span_key, o.o_orderkey AS point_key FROM orders o JOIN s ON s.o_custkey = o.o_custkey AND o.o_orderdate BETWEEN s.s AND s.e""")
def points_in_spans(t: Tables):
    o = t.orders.select("o_custkey", F.col("o_orderkey").alias("point_key"), "o_orderdate")
    s = t.orders.select("o_custkey", F.col("o_orderkey").alias("span_key"), F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("INTERVAL 7 DAY")).alias("e"))
    return point_in_span_join(o, s, ["o_custkey"], "o_orderdate", ("s", "e"), bucket=7 * 86400).select("o_custkey", "span_key", "point_key")


OUT_SQL = """rec AS (SELECT o_orderkey AS ptid, o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '_345' ELSE '_115' END AS equipment, o_orderdate AS out_ts, o_orderdate + to_days(CAST(1 + o_orderkey % 9 AS INTEGER)) AS in_ts,
o_orderdate - INTERVAL 3 DAY AS first_seen, o_orderdate + INTERVAL 2 DAY AS last_seen FROM orders)"""


def _records(t: Tables):
    o = t.orders
    kind = F.when(F.col("o_orderstatus") == "F", "_345").otherwise("_115")
    return o.select(F.col("o_orderkey").alias("ptid"), F.concat("o_orderpriority", kind).alias("equipment"), F.col("o_orderdate").alias("sched_out_utc"),
                    (F.col("o_orderdate") + F.make_dt_interval(1 + F.col("o_orderkey") % 9)).alias("sched_in_utc"),
                    (F.col("o_orderdate") - F.expr("INTERVAL 3 DAY")).alias("first_seen_utc"), (F.col("o_orderdate") + F.expr("INTERVAL 2 DAY")).alias("last_seen_utc"))


@check("known_outages", f"""WITH {OUT_SQL}, dd AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
x AS (SELECT d, timezone('UTC', timezone('America/New_York', CAST(d - 1 AS TIMESTAMP) + INTERVAL 5 HOUR)) AS iss, timezone('UTC', timezone('America/New_York', CAST(d AS TIMESTAMP))) AS d0,
timezone('UTC', timezone('America/New_York', CAST(d + 1 AS TIMESTAMP))) AS d1 FROM dd)
SELECT d, count(DISTINCT ptid || equipment) AS n_outages, count(DISTINCT ptid || equipment) FILTER (equipment LIKE '%345%') AS n_outages_345 FROM x LEFT JOIN rec
ON first_seen <= iss AND iss < last_seen + INTERVAL 5 MINUTE AND out_ts < d1 AND in_ts > d0 GROUP BY 1""")
def known_outages(t: Tables):
    days = t.orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    return known_and_overlapping(_records(t), days)


@check("listed_outages", f"""WITH {OUT_SQL}, l AS (SELECT CAST(first_seen AS DATE) AS list_day, * FROM rec)
SELECT list_day + 1 AS delivery_date, count(DISTINCT equipment) AS dam_outages, count(DISTINCT equipment) FILTER (equipment LIKE '%345%') AS dam_outages_345 FROM l
WHERE in_ts > timezone('UTC', timezone('America/New_York', CAST(list_day + 1 AS TIMESTAMP))) AND out_ts - INTERVAL 2 DAY < timezone('UTC', timezone('America/New_York', CAST(list_day + 2 AS TIMESTAMP))) GROUP BY 1""")
def outages_on_list(t: Tables):
    r = _records(t).withColumn("list_day", F.to_date("first_seen_utc")).withColumn("sched_out_utc", F.col("sched_out_utc") - F.expr("INTERVAL 2 DAY"))
    return listed_outages(r)


@check("expected_out_hours", f"""WITH {OUT_SQL}, l AS (SELECT CAST(out_ts AS DATE) - 1 AS list_day, equipment, out_ts + INTERVAL 7 HOUR AS o, out_ts + INTERVAL 31 HOUR AS i FROM rec),
h AS (SELECT list_day + 1 AS d, equipment, o, i, unnest(range(24)) AS hr FROM l), u AS (SELECT d, hr, equipment, o, i, timezone('UTC', timezone('America/New_York', CAST(d AS TIMESTAMP) + to_hours(hr))) AS h0 FROM h)
SELECT DISTINCT d, CAST(hr AS INTEGER) AS hr, equipment FROM u WHERE o < h0 + INTERVAL 1 HOUR AND i > h0""")
def expected_out_hours(t: Tables):
    r = _records(t)
    r = r.select(F.date_sub(F.to_date("sched_out_utc"), 1).alias("list_day"), "equipment", (F.col("sched_out_utc") + F.expr("INTERVAL 7 HOUR")).alias("sched_out_utc"),
                 (F.col("sched_out_utc") + F.expr("INTERVAL 31 HOUR")).alias("sched_in_utc"))
    return expected_out(r)


TOKENS_SQL = """keys AS (SELECT DISTINCT p_type || ' ' || p_name || ' | ' || p_brand AS key, p_type, p_name, p_brand FROM part),
eq AS (SELECT DISTINCT p_type AS equipment FROM part UNION SELECT DISTINCT p_brand FROM part),
ktok AS (SELECT DISTINCT key, 'facility' AS side, substr(regexp_replace(upper(w), '[^A-Z0-9]', '', 'g'), 1, 8) AS tok FROM (SELECT key, unnest(string_split(p_type || ' ' || p_name, ' ')) AS w FROM keys)
UNION SELECT DISTINCT key, 'contingency', substr(regexp_replace(split_part(upper(p_brand), '#', 1), '[^A-Z0-9]', '', 'g'), 1, 8) FROM keys),
etok AS (SELECT equipment, substr(regexp_replace(substr(upper(equipment), 1, 8), '[^A-Z0-9]', '', 'g'), 1, 8) AS tok FROM eq)"""


@check("name_token_match", f"WITH {TOKENS_SQL} SELECT DISTINCT key, equipment, side FROM ktok JOIN etok USING (tok) WHERE tok <> ''")
def name_token_match(t: Tables):
    key = names.constraint_key(F.concat_ws(" ", "p_type", "p_name"), F.col("p_brand"))
    keys = t.part.select(key.alias("key")).distinct()
    eq = t.part.select(F.col("p_type").alias("equipment")).union(t.part.select("p_brand")).distinct()
    return name_match(keys, eq)


@check("source_preference", """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v, 'orders' AS src FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT l_orderkey AS k, max(l_extendedprice) AS v, 'lines' AS src FROM lineitem GROUP BY 1)
SELECT * FROM o UNION ALL SELECT * FROM l ANTI JOIN o USING (k)""")
def source_preference(t: Tables):
    o = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit("orders").alias("src"))
    l = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("v")).withColumn("src", F.lit("lines"))
    return prefer_published(o, l, ["k"])


@check("settled_semi_join", """SELECT o_custkey, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""")
def settled_semi_join(t: Tables):
    hit = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(hit, "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@check("multi_parent_alignment", f"""WITH {PRED_SQL} SELECT a.d AS delivery_date, a.zone, a.market, a.mean AS m_0, b.mean AS m_1, c.mean AS m_2, a.y FROM pred a JOIN pred b USING (d, zone, market) JOIN pred c USING (d, zone, market)
WHERE a.trial = 'm1' AND b.trial = 'm7' AND c.trial = 'm2'""")
def multi_parent_alignment(t: Tables):
    from wattline.plans.postprocess import align

    return align(parents(t)).select("delivery_date", "zone", "market", "m_0", "m_1", "m_2", "y")


@check("latest_union_of_runs", f"""WITH {PRED_SQL} SELECT d AS delivery_date, zone, market, CASE WHEN d >= DATE '1999-01-01' THEN m7 ELSE m1 END AS mean FROM (
SELECT d, zone, market, max(mean) FILTER (trial = 'm1') AS m1, max(mean) FILTER (trial = 'm7') AS m7 FROM pred GROUP BY 1, 2, 3)""")
def latest_union_of_runs(t: Tables):
    p = t.predictions().select("delivery_date", "zone", "market", "trial", "mean")
    old, new = p.filter("trial = 'm1'").drop("trial"), p.filter("trial = 'm7' AND delivery_date >= DATE '1999-01-01'").drop("trial")
    return latest_union([old, new], ["delivery_date", "zone", "market"])


@check("key_set_changes", """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1998)
SELECT CASE WHEN b.o_custkey IS NULL THEN 'dropped' WHEN a.o_custkey IS NULL THEN 'added' ELSE 'common' END AS change, count(*) AS n FROM a FULL JOIN b ON a.o_custkey = b.o_custkey GROUP BY 1""")
def key_set_changes(t: Tables):
    y = lambda k: t.orders.filter(F.year("o_orderdate") == k).select("o_custkey").distinct()            # noqa: E731
    j = y(1997).withColumn("a", F.lit(1)).join(y(1998).withColumn("b", F.lit(1)), "o_custkey", "full")
    change = F.when(F.col("b").isNull(), "dropped").when(F.col("a").isNull(), "added").otherwise("common")
    return j.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@check("missing_calendar_days", f"""WITH {BOOK_SQL}, s AS (SELECT zone, min(d) AS a, max(d) AS b FROM book GROUP BY 1), c AS (SELECT zone, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM s)
SELECT zone, d FROM c ANTI JOIN book USING (zone, d)""")
def missing_calendar_days(t: Tables):
    b = t.book()
    spine = b.groupBy("zone").agg(F.min("d").alias("a"), F.max("d").alias("b")).select("zone", F.explode(F.sequence("a", "b")).alias("d"))
    return spine.join(b.select("zone", "d"), ["zone", "d"], "left_anti")


@check("points_without_zone", """SELECT DISTINCT l_partkey AS ptid, 'node' AS kind FROM lineitem WHERE l_partkey NOT IN (SELECT l_suppkey FROM lineitem) UNION ALL SELECT DISTINCT l_suppkey, 'zone' FROM lineitem""")
def points_without_zone(t: Tables):
    from wattline.plans.derived import priced_points

    return priced_points(t.lineitem.select(F.col("l_suppkey").alias("ptid")), t.lineitem.select(F.col("l_partkey").alias("ptid")))


@check("market_pivot", f"WITH {BOOK_SQL} SELECT d, zone, da AS da_v, rt AS rt_v FROM book")
def market_pivot(t: Tables):
    b = t.book()
    long = b.select("d", "zone", F.explode(F.array(*[F.struct(F.lit(m).alias("market"), F.col(m).alias("v")) for m in ("da", "rt")])).alias("r")).select("d", "zone", "r.*")
    return markets_wide(long, ["d", "zone"], ["v"])


TARGET_SQL = " UNION ALL ".join(f"SELECT d AS delivery_date, zone, '{m}' AS market, '{c}' AS component, round({m} * {k}, 6) AS y FROM book"
                                for m in ("da", "rt") for c, k in (("total", 1.0), ("energy", 0.6), ("loss", 0.1), ("congestion", 0.3)))


@check("targets_long", f"WITH {BOOK_SQL} {TARGET_SQL}")
def targets(t: Tables):
    b = t.book()
    cols = {f"{m}_{c}": F.round(F.col(m) * k, 6) for m in ("da", "rt") for c, k in (("total", 1.0), ("energy", 0.6), ("loss", 0.1), ("congestion", 0.3))}
    p = b.withColumns({**cols, "delivery_date": F.col("d"), "ts_utc": F.col("d").cast("timestamp"), "hour_local": F.lit(0), "score_da": F.lit(True), "score_rt": F.lit(True)})
    return targets_long(p).select("delivery_date", "zone", "market", "component", "y")


@check("event_types_by_day", """SELECT CAST(ts AS DATE) AS d, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1""")
def event_types_by_day(t: Tables):
    g = t.events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    p = pivot_values(g, ["d"], "event_type", ["click", "view", "error"], "n")
    return p.na.fill(0)


@check("totals_by_rollup", """SELECT CAST(ts AS DATE) AS d, CASE WHEN grouping(event_type) = 1 THEN 'ALL' ELSE event_type END AS zone, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY CAST(ts AS DATE), ROLLUP (event_type)""")
def totals_by_rollup(t: Tables):
    e = with_total(t.events.select(F.to_date("ts").alias("d"), F.col("event_type").alias("zone"), F.col("value").cast("decimal(18,2)").alias("v")))
    return e.groupBy("d", "zone").agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total"))


@check("scores_melted", """WITH s AS (SELECT l_returnflag AS zone, CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS mae FROM lineitem GROUP BY 1)
SELECT zone, 'n' AS metric, n AS value FROM s UNION ALL SELECT zone, 'mae', round(mae, 6) FROM s""")
def scores_melted(t: Tables):
    s = t.lineitem.groupBy(F.col("l_returnflag").alias("zone")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mae"))
    return melt_scores(s, ["zone"])


@check("running_pnl_drawdown", f"""WITH {BOOK_SQL}, x AS (SELECT zone, d, round(da - rt, 4) AS pnl FROM book), c AS (SELECT zone, d, pnl, sum(pnl) OVER (PARTITION BY zone ORDER BY d) AS cum FROM x)
SELECT zone, d, pnl, round(cum, 4) AS cum, round(cum - max(cum) OVER (PARTITION BY zone ORDER BY d), 4) AS cum_drawdown FROM c""")
def running_pnl_drawdown(t: Tables):
    x = t.book().select("zone", "d", F.round(F.col("da") - F.col("rt"), 4).alias("pnl"))
    return rounded(running(x, ["zone"], "d", "pnl", "cum"), 4)


@check("top_parts_per_supplier", """SELECT l_suppkey, l_partkey, revenue, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY revenue DESC, l_partkey) AS rank FROM (
SELECT l_suppkey, l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1, 2)) WHERE rank <= 5""")
def top_parts(t: Tables):
    g = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
    return top_per_group(g, ["l_suppkey"], [F.desc("revenue"), F.asc("l_partkey")], 5).withColumn("rank", F.col("rank").cast("bigint"))


@check("latest_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def latest_rows(t: Tables):
    return at_latest(t.orders, "o_orderdate").select("o_orderkey", "o_totalprice")


AREAS = {"a": [(0, 0), (30, 0), (15, 6)], "b": [(20, 2), (50, 2), (50, 10), (35, 5), (20, 10)], "c": [(5, 7), (18, 7), (18, 11), (5, 11)]}
EDGES = [(a, *p, *q) for a, ring in AREAS.items() for p, q in zip(ring, ring[1:] + ring[:1])]
EDGE_SQL = ", ".join(f"('{a}', {x1}.0, {y1}.0, {x2}.0, {y2}.0)" for a, x1, y1, x2, y2 in EDGES)


@check("points_in_areas", f"""WITH e AS (SELECT * FROM (VALUES {EDGE_SQL}) t(area, x1, y1, x2, y2)), p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + 0.3 AS x, round(l_discount * 100, 0) + 0.4 AS y FROM lineitem)
SELECT area, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, l_partkey, area FROM p JOIN e ON (y1 > y) <> (y2 > y) AND x < x1 + (x2 - x1) * (y - y1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY 1""")
def points_in_areas(t: Tables):
    edges = t.spark.createDataFrame([(a, float(b), float(c), float(d), float(e)) for a, b, c, d, e in EDGES], "area string, x1 double, y1 double, x2 double, y2 double")
    p = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") + 0.3).alias("lon"), (F.round(F.col("l_discount") * 100, 0) + 0.4).alias("lat"))
    return points_in_polygons(p, edges, ["l_orderkey", "l_linenumber", "l_partkey"], "area", cell=1.0).groupBy("area").agg(F.count(F.lit(1)).alias("n"))


NODES_SQL = """nodes AS (SELECT s_suppkey AS ptid, s_name AS name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS lat, s_nationkey::DOUBLE AS lon, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_tax = 0) AS has_prices FROM supplier)"""


def _nodes(t: Tables):
    n = t.supplier.select(F.col("s_suppkey").cast("bigint").alias("ptid"), F.col("s_name").alias("name"), F.lit("z").alias("zone"), F.lit("s").alias("subzone"),
                          F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("lat"), F.col("s_nationkey").cast("double").alias("lon"))
    return flag_priced(n, _priced(t))


def _priced(t: Tables):
    return t.lineitem.filter("l_quantity > 49 AND l_tax = 0").select(F.col("l_suppkey").alias("ptid"))


@check("mappable_nodes", f"WITH {NODES_SQL} SELECT ptid, name, 'z' AS zone, 's' AS subzone, lat, lon FROM nodes WHERE lat IS NOT NULL AND has_prices")
def nodes_with_prices(t: Tables):
    return mappable_nodes(_nodes(t))


@check("reference_report", f"""WITH {NODES_SQL}, ids AS (SELECT DISTINCT l_suppkey AS ptid FROM lineitem WHERE l_quantity > 49 AND l_tax = 0)
SELECT count(*) AS generators, count(*) FILTER (lat IS NOT NULL) AS with_coords, count(*) FILTER (lat IS NOT NULL AND has_prices) AS priced_with_coords,
(SELECT count(*) FROM ids) AS priced_nodes, (SELECT count(*) FROM ids WHERE ptid NOT IN (SELECT s_suppkey FROM supplier)) AS priced_missing FROM nodes""")
def node_report(t: Tables):
    return reference_report(_nodes(t), _priced(t))


@check("county_majority", """SELECT c_nationkey AS county, c_mktsegment AS zone FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1""")
def county_majority(t: Tables):
    from wattline.sources.geography import county_zones

    votes = t.customer.select(F.col("c_nationkey").alias("county"), F.col("c_mktsegment").alias("zone"))
    counties = t.nation.select(F.col("n_nationkey").alias("county"), F.col("n_nationkey").cast("double").alias("cx"), F.lit(0.0).alias("cy"))
    nodes = t.customer.select(F.col("c_mktsegment").alias("zone"), F.col("c_nationkey").cast("double").alias("lon"), F.lit(0.0).alias("lat"))
    return county_zones(counties, votes, nodes)
