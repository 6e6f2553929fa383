from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from wattline.operators.timeweight import time_weighted
from wattline.sources import auctions, external, feeds, geography, warehouse


def write(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n")
    return str(p)


HEAD = "Time Stamp,Name,PTID,LBMP ($/MWHr),Marginal Cost Losses ($/MWHr),Marginal Cost Congestion ($/MWHr)"


def naive(df, *cols):
    return df.select(*[F.col(c).cast("timestamp_ntz") if t == "timestamp" else F.col(c) for c, t in df.select(*cols).dtypes])


def test_fall_back_day_by_file_order(spark, tmp_path):
    hours = ["00", "01", "01", *[f"{h:02d}" for h in range(2, 24)]]
    rows = [f"11/02/2025 {h}:00,{z},{p},{10 + i}.0,1.0,-2.0" for i, h in enumerate(hours) for z, p in (("WEST", 61752), ("CAPITL", 61757))]
    path = write(tmp_path, "20251102damlbmp_zone.csv", ["﻿" + HEAD, *rows])
    df = feeds.read_feed(spark, path, "da_lbmp_zone")
    got = [r[0] for r in naive(df.filter("zone = 'WEST'").orderBy("ts_utc"), "ts_utc").collect()]
    assert len(got) == 25 and got[0] == datetime(2025, 11, 2, 4) and got[-1] == datetime(2025, 11, 3, 4)
    assert df.filter("zone = 'CAPITL'").count() == 25 and df.filter("lbmp IS NULL").count() == 0


def test_off_grid_repeated_hour_end_stamps(spark, tmp_path):
    """A stamp that occurs once inside the repeated hour is still standard time, because the clock stepped back before it."""
    stamps = ["00:55:00", "01:00:00", "01:30:00", "01:55:00", "01:00:00", "01:02:48", "01:05:00"]
    path = write(tmp_path, "20211107realtime_zone.csv", [HEAD, *[f"11/07/2021 {s},WEST,61752,{i}.0,0,0" for i, s in enumerate(stamps)]])
    df = feeds.read_feed(spark, path, "rt_lbmp_zone").orderBy("ts_utc")
    got = [r[0].strftime("%H:%M:%S") for r in naive(df, "ts_utc").collect()]
    assert got == ["04:50:00", "04:55:00", "05:25:00", "05:50:00", "05:55:00", "05:57:48", "06:00:00"]


def test_flagged_zone_alias_bad_values_and_dedupe(spark, tmp_path):
    old = HEAD.replace("Congestion ($/MWHr)", "Congestion ($/MWH")
    a = write(tmp_path, "20150101damlbmp_zone.csv", [old, "01/01/2015 00:00,WEST,61752,n/a,1,2", "01/01/2015 00:00,WEST,61752,7,1,2"])
    row = feeds.read_feed(spark, a, "da_lbmp_zone").collect()
    assert len(row) == 1 and row[0]["lbmp"] == 7.0 and row[0]["mcc"] == 2.0
    b = write(tmp_path, "20251102pal.csv", ["Time Stamp,Time Zone,Name,PTID,Load", "11/02/2025 01:00:00,EDT,WEST,1,5", "11/02/2025 01:00:00,EST,WEST,1,6"])
    got = [r[0].hour for r in naive(feeds.read_feed(spark, b, "load").orderBy("ts_utc"), "ts_utc").collect()]
    assert got == [5, 6]
    gap = write(tmp_path, "20250309damlbmp_zone.csv", [HEAD, "03/09/2025 02:30,WEST,61752,7,1,2"])
    assert naive(feeds.read_feed(spark, gap, "da_lbmp_zone"), "ts_utc").first()[0] == datetime(2025, 3, 9, 7)


def test_wide_forecast(spark, tmp_path):
    p = write(tmp_path, "20251101isolf.csv", ["Time Stamp,Capitl,West,System", "11/02/2025 01:00,1,2,3", "11/02/2025 01:00,1,2,3", "11/02/2025 02:00,4,5,9"])
    df = feeds.read_feed(spark, p, "load_forecast")
    assert df.count() == 9 and {r[0] for r in df.select("zone").distinct().collect()} == {"CAPITL", "WEST", "SYSTEM"}
    assert df.select("issue_date").distinct().first()[0] == date(2025, 11, 1)


def test_every_file_by_its_own_header(spark, tmp_path):
    a = write(tmp_path, "20250601pal.csv", ["Time Stamp,Time Zone,Name,PTID,Load", "06/01/2025 01:00:00,EDT,WEST,61752,100"])
    b = write(tmp_path, "20250602pal.csv", ["\ufeffTime Stamp, Time Zone, Name, Load, PTID, Extra", '06/02/2025 01:00:00,EDT,"WE,ST",200,61757,9', "", "06/02/2025 02:00:00,EDT,N,,61758"])
    got = {(r["zone"], r["ptid"], r["load_mw"]) for r in feeds.read_feed(spark, [a, b], "load").collect()}
    assert got == {("WEST", 61752, 100.0), ("WE,ST", 61757, 200.0), ("N", 61758, None)}
    c = write(tmp_path, "20250603pal.csv", ["Time Stamp,Time Zone,Name,PTID", "06/03/2025 01:00:00,EDT,WEST,61752"])
    with pytest.raises(Exception, match="lacks columns .Load."):
        feeds.read_feed(spark, [a, c], "load").collect()


def test_wide_files_with_different_zones(spark, tmp_path):
    a = write(tmp_path, "20251101isolf.csv", ["Time Stamp,Capitl,West", "11/02/2025 03:00,1,2"])
    b = write(tmp_path, "20251102isolf.csv", ["Time Stamp,West,Millwd,Capitl", "11/03/2025 03:00,5,6,7"])
    got = {(r["issue_date"].day, r["zone"], r["load_forecast_mw"]) for r in feeds.read_feed(spark, [a, b], "load_forecast").collect()}
    assert got == {(1, "CAPITL", 1.0), (1, "WEST", 2.0), (2, "WEST", 5.0), (2, "MILLWD", 6.0), (2, "CAPITL", 7.0)}


def test_snapshot_compaction(spark, tmp_path):
    line = "{},7,LINE A,06/01/2025 08:00,06/02/2025 17:00"
    rows = [line.format(f"06/01/2025 00:{m:02d}:00") for m in range(0, 30, 5)] + [line.format("06/01/2025 01:15:00"), line.format("06/01/2025 01:20:00")]
    p = write(tmp_path, "20250601SCLineOutages.csv", ["Timestamp,PTID,Equipment Name,Scheduled Out Date/Time,Scheduled In Date/Time", *rows])
    df = feeds.read_feed(spark, p, "sched_outages")
    assert sorted(r["snapshots"] for r in df.collect()) == [2, 6]


def toy(spark, rows):
    return spark.createDataFrame([(datetime.strptime("2024-01-01 " + t, "%Y-%m-%d %H:%M:%S"), "a", float(v)) for t, v in rows], "t timestamp_ntz, e string, v double").select(
        F.col("t").cast("timestamp").alias("ts_utc"), "e", "v")


@pytest.mark.parametrize("rows,bucket,stamped,expect", [
    ([("06:50:00", 0), ("06:55:00", 10), ("06:57:30", 100), ("07:00:00", 40)], 300, "end", {"07:00": (70.0, 300.0), "06:55": (10.0, 300.0)}),
    ([("06:50:00", 0), ("06:53:00", 10), ("06:57:30", 100), ("07:00:00", 40)], 3600, "end", {"06:00": ((0 * 300 + 10 * 180 + 100 * 120) / 600, 600.0), "07:00": (70.0, 300.0)}),
    ([("05:55:00", 5), ("06:55:00", 50)], 300, "end", {"06:55": (50.0, 300.0), "05:55": (5.0, 300.0)}),
    ([("07:00:00", 100), ("07:01:00", 200), ("07:05:00", 300)], 300, "start", {"07:00": ((100 * 60 + 200 * 240) / 300, 300.0), "07:05": (300.0, 300.0)}),
])
def test_time_weighting_toys(spark, rows, bucket, stamped, expect):
    out = naive(time_weighted(toy(spark, rows), ["e"], ["v"], bucket, stamped=stamped), "ts_utc", "v", "covered_s").collect()
    got = {r[0].strftime("%H:%M"): (r[1], r[2]) for r in out}
    for k, (v, w) in expect.items():
        assert got[k][0] == pytest.approx(v) and got[k][1] == pytest.approx(w)
    assert "06:05" not in got or bucket != 300


def test_chunk_edges_do_not_change_the_result(spark):
    rows = [(f"{h:02d}:{m:02d}:00", h * 7 + m) for h in range(24) for m in range(0, 60, 4)]
    a, b = (time_weighted(toy(spark, rows), ["e"], ["v"], 300, chunk=c).orderBy("ts_utc").collect() for c in (86_400, 1800))
    assert a == b


def test_auction_labels_and_reports(spark):
    labels = spark.createDataFrame([(1, "2026 Autumn Centralized TCC Auction - Six Month - Round 3 (Ver 2 - Approved)"), (2, "2025 Winter Balance-of-Period (Ver 1 - Final)")], "round_id long, label string")
    r = {x["round_id"]: x for x in auctions.decode_rounds(labels).collect()}
    assert (r[1]["kind"], r[1]["round_no"], r[1]["term_months"], r[1]["season_year"]) == ("centralized", 3, 6, 2026) and r[2]["kind"] == "bop"
    with pytest.raises(Exception, match="unrecognised"):
        auctions.decode_rounds(spark.createDataFrame([(3, "what is this")], "round_id long, label string")).collect()
    head = "Period ID,Period Name,Period Duration (Months),Start Date,End Date,PTID,PTID Name,Zone,Nodal Price ($)"
    text = "\n".join(["TCC Nodal Prices", '"Posted: August 27, 2026"', "Current Status - Approved", "", head, '1,"Sep, 26",1,09/01/2026,09/30/2026,61752,WEST,WEST,-12.5', "Report Created 08/27/2026"])
    d = auctions.parse_reports(spark.createDataFrame([(9, text)], "round_id long, text string"), head).collect()
    assert len(d) == 1 and d[0]["nodal_price"] == -12.5 and d[0]["posted_date"] == date(2026, 8, 27) and d[0]["status"] == "Approved" and d[0]["poi"] == 61752


def test_outage_schedule_and_gas(spark, tmp_path):
    write(tmp_path, "20260105T1130Z.csv", ["PTID,Outage ID,Equipment Name,Equipment Type,Date Out,Time Out,Date In,Time In,Called In,Status,Status Date",
                                           "5,77,LINE B,LINE,01/10/2026,08:00,01/11/2026,17:00,N,APP,01-05-2026 06:00"])
    r = external.read_outage_schedule(spark, str(tmp_path / "*.csv"))
    row = naive(r, "snapshot_utc", "sched_out_utc", "status_date_utc").first()
    assert row == (datetime(2026, 1, 5, 11, 30), datetime(2026, 1, 10, 13), datetime(2026, 1, 5, 11))
    g = external.gas_prices(spark.createDataFrame([(date(2025, 7, 1), 3.5)], "trade_date date, price_usd_mmbtu double"))
    assert naive(g, "available_utc").first()[0] == datetime(2025, 7, 2, 4)


def test_polygon_with_hole(spark):
    ring = lambda pts: [(*a, *b) for a, b in zip(pts, pts[1:] + pts[:1])]          # noqa: E731
    rows = [("z", *map(float, e)) for e in ring([(0, 0), (4, 0), (4, 4), (0, 4)]) + ring([(1, 1), (2, 1), (2, 2), (1, 2)])]
    edges = spark.createDataFrame(rows, "zone string, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 3.5, 1.5), (4, 5.0, 1.0)], "id int, lon double, lat double")
    assert sorted(r["id"] for r in geography.points_in_polygons(pts, edges, ["id"], "zone").collect()) == [1, 3]


def test_month_partitions_and_incremental_plan(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-31 12:00:00' + make_dt_interval(i) AS ts_utc, i AS ptid FROM (SELECT explode(sequence(0, 40)) i)")
    path = str(tmp_path / "t")
    warehouse.write_months(df, path, F.col("ts_utc"), files_per_month=2)
    warehouse.write_months(df.filter("month(ts_utc) = 2").withColumn("ptid", F.col("ptid") + 100), path, F.col("ts_utc"))
    got = warehouse.read_table(spark, path, date(2024, 2, 1), date(2024, 3, 1))
    assert got.count() == 29 and got.agg(F.min("ptid")).first()[0] == 101 and warehouse.read_table(spark, path).count() == 41
    wanted = warehouse.wanted_months(spark, ["a"], date(2024, 1, 5), date(2024, 4, 1))
    man = spark.createDataFrame([("a", date(2024, 1, 1), date(2024, 2, 2)), ("a", date(2024, 2, 1), date(2024, 3, 1)), ("a", date(2024, 4, 1), date(2024, 6, 1))], "key string, month date, written_at date")
    todo = sorted(r["month"] for r in warehouse.backfill_plan(wanted, man, date(2024, 4, 20)).collect())
    assert todo == [date(2024, 2, 1), date(2024, 3, 1), date(2024, 4, 1)]
