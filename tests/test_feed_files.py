"""The feed data source: pruning by file name, one partition a run of files, streamed corrections."""

import os
from datetime import date

from pyspark.sql import functions as F

from wattline.sources import feed_files, feeds

HEAD = "Time Stamp,Time Zone,Name,PTID,Load"


def put(folder, day, lines, head=HEAD, stem="pal", at=None):
    p = folder / f"{day}{stem}.csv"
    p.write_text("\n".join([head, *lines]) + "\n")
    if at:
        os.utime(p, ns=(at, at))
    return str(p)


def filled(tmp_path):
    for d in range(1, 8):
        put(tmp_path, f"2025060{d}", [f'06/0{d}/2025 0{h}:00:00,EDT,"ZONE, {h}",{h},{100 * d + h}' for h in range(3)])
    put(tmp_path, "20250601", ["x"], stem="isolf")
    (tmp_path / "notes.csv").write_text("no date\n1\n")
    return str(tmp_path)


def test_rows_equal_the_text_reader(spark, tmp_path):
    folder = filled(tmp_path)
    own = feed_files.load_feed(spark, folder, "load")
    text = feeds.read_feed(spark, f"{folder}/*pal.csv", "load")
    assert own.columns == text.columns and own.count() == 21 and own.exceptAll(text).count() == 0


def test_dates_prune_files_before_they_are_opened(spark, tmp_path):
    folder = filled(tmp_path)
    bad = put(tmp_path, "20250609", [])
    os.chmod(bad, 0)
    (tmp_path / "20250610pal.csv").write_bytes(b"\xff\xfe broken header\n1\n")          # would fail the header check if it were read
    rows = feed_files.feed_rows(spark, folder, "load").where((F.col("_date") > date(2025, 6, 2)) & (F.col("_date") <= date(2025, 6, 4)))
    assert sorted({r["_date"].day for r in rows.collect()}) == [3, 4]
    assert feed_files.load_feed(spark, folder, "load", date(2025, 6, 7), date(2025, 6, 8)).count() == 3
    assert feed_files.feed_rows(spark, folder, "load").where(F.col("_date").isin(date(2025, 6, 1), date(2025, 6, 5))).count() == 6
    assert feed_files.feed_rows(spark, folder, "load").where("_date = DATE'2031-01-01'").count() == 0
    reader = feed_files._Batch({"path": folder, "feed": "load", "bytespartition": "1"})
    assert len(reader.partitions()) == 9                                                 # one file a partition, without filters
    assert list(reader.pushFilters([feed_files.GreaterThan(("_date",), date(2025, 6, 5)), feed_files.EqualTo(("_pos",), 1)])) == [feed_files.EqualTo(("_pos",), 1)]
    assert sum(len(p.paths) for p in reader.partitions()) == 4


def test_stream_takes_new_and_corrected_files(spark, tmp_path):
    folder, log, out = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "out")
    folder.mkdir()

    def run():
        rows = feed_files.feed_row_stream(spark, str(folder), "load")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).count()

    line = "06/01/2025 00:00:00,EDT,WEST,1,{}".format
    put(folder, "20250601", [line(5)], at=10**18)
    put(folder, "20250602", [line(6)], at=10**18)
    assert run() == 2 and run() == 2
    put(folder, "20250531", [line(7)], at=2 * 10**18)                                    # an older day that comes later
    assert run() == 3
    put(folder, "20250601", [line(8)], at=3 * 10**18)                                    # a corrected file
    assert run() == 4
    latest = feeds.parse_feed(spark.read.parquet(out).drop("_date"), feeds.FEEDS["load"])
    assert sorted(r["load_mw"] for r in latest.collect()) == [5.0, 6.0, 7.0, 8.0]
