"""Feed files, nearest nodes and trade days with gaps."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from wattline.checks.base import BOOK_SQL, Tables, check, rounded
from wattline.functions.sql import register_functions
from wattline.plans.monthly import gas_at
from wattline.session import checkpoint_dir
from wattline.sources import feed_files as feed_files_source
from wattline.sources import feeds
from wattline.sources.geography import nearest_zone


def _daily_files(t: Tables):
    """orders as lines of daily load files; on even days the header has another order and a column more."""
    o = t.orders.withColumn("d", F.to_date("o_orderdate"))
    even = F.day("d") % 2 == 0
    file = F.concat(F.lit("in/"), F.date_format("d", "yyyyMMdd"), F.lit("pal.csv"))
    stamp = F.concat(F.date_format("d", "MM/dd/yyyy"), F.lit(" "), F.lpad((F.col("o_orderkey") % 8 + 9).cast("string"), 2, "0"), F.lit(":00:00"))
    zone, ptid, load = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(', "')), (F.col("o_custkey") % 40).cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    body = F.when(even, F.concat_ws(", ", stamp, zone, load, F.lit("x"), ptid, F.lit("EST"))).otherwise(F.concat_ws(",", stamp, F.lit("EST"), zone, ptid, load))
    head = F.when(even, F.lit("Time Stamp,Name,Load,Remark,PTID,Time Zone")).otherwise(F.lit("Time Stamp,Time Zone,Name,PTID,Load"))
    rows = o.select(file.alias("_file"), F.struct(F.lit(0).cast("long").alias("block"), F.col("o_orderkey").alias("row")).alias("_pos"), body.alias("value"))
    heads = o.select("d").distinct().select(file.alias("_file"), F.struct(F.lit(0).cast("long").alias("block"), F.lit(-1).cast("long").alias("row")).alias("_pos"), head.alias("value"))
    return rows.unionByName(heads)


@check("feed_files_by_own_header", """SELECT CAST(o_orderdate AS DATE) + to_hours(CAST(o_orderkey % 8 + 9 AS INTEGER)) AS ts_local, o_custkey % 40 AS ptid, arg_max(o_orderpriority, o_orderkey) || ',' AS zone,
CAST(arg_max(CAST(o_totalprice AS DECIMAL(18,2)), o_orderkey) AS DOUBLE) AS load_mw FROM orders GROUP BY 1, 2""")
def feed_files(t: Tables):
    rows = feeds.rows_of_lines(_daily_files(t))
    return feeds.curate(rows, feeds.FEEDS["load"]).select(F.col("ts_local").cast("timestamp_ntz").alias("ts_local"), "ptid", "zone", "load_mw")


@check("nearest_node_any_distance", """WITH p AS (SELECT n_name AS county, n_nationkey * 40.0 - 300 AS cx, n_regionkey * 20.0 - 50 AS cy FROM nation), n AS (SELECT 'z' || s_suppkey AS zone, s_acctbal / 50 AS lon, s_nationkey * 3.0 AS lat FROM supplier)
SELECT county, arg_min(zone, row(sqrt((lon - cx) * (lon - cx) + (lat - cy) * (lat - cy)), zone)) AS zone FROM p, n GROUP BY 1""")
def nearest_node(t: Tables):
    points = t.nation.select(F.col("n_name").alias("county"), (F.col("n_nationkey") * 40.0 - 300).alias("cx"), (F.col("n_regionkey") * 20.0 - 50).alias("cy"))
    nodes = t.supplier.select(F.concat(F.lit("z"), "s_suppkey").alias("zone"), (F.col("s_acctbal") / 50).alias("lon"), (F.col("s_nationkey") * 3.0).alias("lat"))
    return nearest_zone(points, nodes).withColumnRenamed("_nearest", "zone")


GAS_SQL = f"""WITH {BOOK_SQL}, g AS (SELECT d, avg(rt) AS hh FROM book WHERE month(d) <= 3 GROUP BY 1), c AS (SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS cutoff FROM book),
r AS (SELECT cutoff, hh, row_number() OVER (PARTITION BY cutoff ORDER BY g.d DESC) AS i FROM c JOIN g ON g.d <= c.cutoff - 7)
SELECT cutoff, round(avg(hh), 3) AS gas FROM r WHERE i <= 10 GROUP BY 1"""


@check("gas_over_long_gaps", GAS_SQL)
def gas_over_gaps(t: Tables):
    """Trade days of the first quarter only: the later cutoffs of a year look back over a gap of up to nine months."""
    b = t.book()
    gas = b.where(F.month("d") <= 3).groupBy(F.col("d").alias("trade_date")).agg(F.avg("rt").alias("hh"))
    return rounded(gas_at(gas, b.select(F.trunc("d", "MM").alias("cutoff"))), 3)


# ------------------------------------------------------------------------------------------ both edges of daylight saving, wide files, schedules, the data source

NY = "America/New_York"
HOURS_SQL = f"""{BOOK_SQL}, days AS (SELECT DISTINCT d FROM book WHERE month(d) IN (4, 10)),
hours AS (SELECT d, unnest(generate_series(timezone('{NY}', CAST(d AS TIMESTAMP)), timezone('{NY}', CAST(d + 1 AS TIMESTAMP)) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM days)"""


def _clock_lines(t: Tables, zones, cells, header: str, stem: str, shuffled: bool):
    """Every hour of the days in April and October, the months of both clock changes: one line a row of `zones`, as published by the wall clock."""
    days = t.book().where(F.month("d").isin(4, 10)).select("d", "zone", "da")
    at = lambda day: F.unix_seconds(F.to_utc_timestamp(day.cast("timestamp"), NY))                 # noqa: E731
    hour = F.explode(F.sequence(at(F.col("d")), at(F.date_add("d", 1)) - 3600, F.lit(3600))).alias("s")
    rows = zones(days).select("*", hour)
    local = F.from_utc_timestamp(F.timestamp_seconds("s"), NY)
    rows = rows.withColumn("stamp", F.date_format(local, "MM/dd/yyyy HH:mm")).withColumn("summer", F.unix_seconds(local) - F.col("s") == -4 * 3600)
    place = F.xxhash64("s", "d") if shuffled else F.col("s")
    file = F.concat(F.lit("in/"), F.date_format("d", "yyyyMMdd"), F.lit(stem), F.lit(".csv"))
    lines = rows.select(file.alias("_file"), F.struct(F.lit(1).cast("long").alias("block"), place.alias("row")).alias("_pos"), cells().alias("value"))
    heads = rows.select("d").distinct().select(file.alias("_file"), F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row")).alias("_pos"), F.lit(header).alias("value"))
    return lines.unionByName(heads)


@check("feed_clock_by_file_order", f"WITH {HOURS_SQL} SELECT CAST(timezone('UTC', ts) AS TIMESTAMP) AS ts_utc, zone, da AS lbmp FROM hours JOIN book USING (d)")
def feed_by_file_order(t: Tables):
    """Day-ahead price files without a flag: the repeated hour is told by the order of its lines."""
    head = "Time Stamp,Name,PTID,LBMP ($/MWHr),Marginal Cost Losses ($/MWHr),Marginal Cost Congestion ($/MWH"
    ptid = F.substring("zone", 1, 1)
    lines = _clock_lines(t, lambda b: b, lambda: F.concat_ws(",", "stamp", "zone", ptid, F.col("da").cast("string"), F.lit("0"), F.lit("x")), head, "damlbmp_zone", False)
    return rounded(feeds.curate(feeds.rows_of_lines(lines), feeds.FEEDS["da_lbmp_zone"]).select("ts_utc", "zone", "lbmp"))


@check("feed_clock_by_flag", f"WITH {HOURS_SQL} SELECT CAST(timezone('UTC', ts) AS TIMESTAMP) AS ts_utc, zone, da AS mw FROM hours JOIN book USING (d)")
def feed_by_flag(t: Tables):
    """Lines in any order, each flagged EDT or EST."""
    flag = F.when(F.col("summer"), "EDT").otherwise("EST")
    lines = _clock_lines(t, lambda b: b, lambda: F.concat_ws(",", "stamp", flag, "zone", F.col("da").cast("string")), "Time Stamp,Time Zone,Zone Name,MW Value", "BTMEstimatedActual", True)
    return rounded(feeds.curate(feeds.rows_of_lines(lines), feeds.FEEDS["btm_solar"]).select("ts_utc", "zone", "mw"))


@check("feed_wide_forecast", f"""WITH {HOURS_SQL} SELECT CAST(timezone('UTC', ts) AS TIMESTAMP) AS ts_utc, upper(zone) AS zone, d AS issue_date, da AS load_forecast_mw FROM hours JOIN book USING (d)
WHERE day(d) % 2 = 1 OR zone IN ('1-URGENT', '3-MEDIUM')""")
def feed_wide(t: Tables):
    """Forecast files with a column a zone: five zones on odd days, two of them in another order on even ones."""
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = lambda b: b.groupBy("d").agg(*[F.max(F.when(F.col("zone") == z, F.col("da"))).cast("string").alias(f"z{i}") for i, z in enumerate(names)])       # noqa: E731
    out = None
    for odd, shown in ((1, [0, 1, 2, 3, 4]), (0, [2, 0])):
        some = lambda b, odd=odd: wide(b.where(F.day("d") % 2 == odd))                             # noqa: E731
        text = lambda shown=shown: F.concat_ws(",", "stamp", *[F.coalesce(f"z{i}", F.lit("")) for i in shown])     # noqa: E731
        lines = _clock_lines(t, some, text, ",".join(["Time Stamp", *[names[i].title() for i in shown]]), "isolf", False)
        out = lines if out is None else out.unionByName(lines)
    got = feeds.curate(feeds.rows_of_lines(out), feeds.FEEDS["load_forecast"])
    return rounded(got.where("load_forecast_mw IS NOT NULL").select("ts_utc", "zone", "issue_date", "load_forecast_mw"))


@check("feed_outage_runs", """WITH r AS (SELECT DISTINCT user_id % 20 AS ptid, CAST(event_type AS VARCHAR) AS equipment, time_bucket(INTERVAL 5 MINUTE, ts) AS ts FROM events WHERE event_type <> 'view'),
f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY ptid, equipment ORDER BY ts) <= INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS s FROM r),
g AS (SELECT *, sum(s) OVER (PARTITION BY ptid, equipment ORDER BY ts) AS run FROM f)
SELECT ptid, equipment, TIMESTAMP '2024-02-01 13:00:00' AS outage_start_utc, min(ts) + INTERVAL 5 HOUR AS first_seen_utc, max(ts) + INTERVAL 5 HOUR AS last_seen_utc, count(*) AS snapshots FROM g GROUP BY ptid, equipment, run""")
def feed_outages(t: Tables):
    """Equipment out of service as published every five minutes (copies included), kept as validity runs; all stamps are winter time."""
    e = t.events.where("event_type <> 'view'").select((F.col("user_id") % 20).alias("ptid"), "event_type", "event_id", F.window("ts", "5 minutes")["start"].alias("at"))
    file = F.concat(F.lit("in/"), F.date_format("at", "yyyyMMdd"), F.lit("RTLineOutages.csv"))
    place = lambda block, row: F.struct(F.lit(block).cast("long").alias("block"), row.cast("long").alias("row")).alias("_pos")       # noqa: E731
    text = F.concat_ws(",", F.date_format("at", "MM/dd/yyyy HH:mm:ss"), F.col("ptid").cast("string"), "event_type", F.lit("02/01/2024 08:00"))
    lines = e.select(file.alias("_file"), place(1, F.unix_seconds("at") * 100_000 + F.col("event_id")), text.alias("value"))
    heads = e.select(file.alias("_file")).distinct().select("_file", place(0, F.lit(0)), F.lit("Timestamp,PTID,Equipment Name,Outage Date/Time").alias("value"))
    out = feeds.curate(feeds.rows_of_lines(lines.unionByName(heads)), feeds.FEEDS["rt_line_outages"])
    return rounded(out.select("ptid", "equipment", "outage_start_utc", "first_seen_utc", "last_seen_utc", F.col("snapshots").cast("long").alias("snapshots")))


def _written(t: Tables, names) -> str:
    """The lines as files of a folder that all share, named as published; a task writes whole files."""
    folder = f"{checkpoint_dir(t.spark)}/feeds-{uuid.uuid4().hex}"
    lines = _daily_files(t)

    def write(it):
        from pyarrow import fs

        for batch in it:
            for row in batch.to_pylist():
                store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
                store.create_dir(root, recursive=True)
                with store.open_output_stream(f"{root}/{row['_file'].rsplit('/', 1)[-1]}") as out:
                    out.write(("\n".join(row["lines"]) + "\n").encode())
        yield from ()

    whole = lines.where(names(F.col("_file"))).groupBy("_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "value"))), lambda x: x["value"]).alias("lines"))
    whole.mapInArrow(write, "n int").count()
    return folder


@check("feed_files_pruned", """SELECT CAST(o_orderdate AS DATE) + to_hours(CAST(o_orderkey % 8 + 9 AS INTEGER)) AS ts_local, o_custkey % 40 AS ptid, arg_max(o_orderpriority, o_orderkey) || ',' AS zone,
CAST(arg_max(CAST(o_totalprice AS DECIMAL(18,2)), o_orderkey) AS DOUBLE) AS load_mw FROM orders WHERE o_orderdate >= DATE '1995-03-01' AND o_orderdate <= DATE '1996-02-29' GROUP BY 1, 2""")
def feed_files_pruned(t: Tables):
    """A year of the daily files through the data source: the other files are not opened."""
    folder = _written(t, lambda name: F.lit(True))
    out = feed_files_source.load_feed(t.spark, folder, "load", date(1995, 3, 1), date(1996, 2, 29))
    return out.select(F.col("ts_local").cast("timestamp_ntz").alias("ts_local"), "ptid", "zone", "load_mw")


@check("sql_functions", f"""WITH {BOOK_SQL}, days AS (SELECT DISTINCT d FROM book WHERE month(d) IN (4, 10)),
h AS (SELECT d, unnest(generate_series(timezone('{NY}', CAST(d AS TIMESTAMP)), timezone('{NY}', CAST(d + 1 AS TIMESTAMP)) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM days)
SELECT d, count(*) AS hours, CAST(max(hour(timezone('{NY}', ts))) AS INTEGER) AS last_hour, round(sum(da * rt) / sum(rt), 4) AS mean FROM h JOIN book USING (d) GROUP BY d""")
def sql_functions(t: Tables):
    """The session's SQL functions: the day grid, the wall clock and the weighted mean."""
    register_functions(t.spark)
    t.book().where(F.month("d").isin(4, 10)).createOrReplaceTempView("wattline_book")
    return rounded(t.spark.sql("""SELECT d, count(*) AS hours, max(hour(to_local(g.ts_utc))) AS last_hour, weighted_mean(sum(da * rt), sum(rt)) AS mean
        FROM wattline_book, LATERAL day_grid(d, 60) AS g GROUP BY d"""), 4)
