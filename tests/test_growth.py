"""Steps whose cost grew too fast on larger tables."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.checks.base import Tables
from wattline.checks.network import constraint_windows, shadow
from wattline.models.naive import long_forecast
from wattline.operators.ordered import _place, exact_quantiles
from wattline.plans import backtest
from wattline.plans.folds import Fold, assign_test_fold
from wattline.plans.registry import Registry
from wattline.plans.structure import constraint_catalogue
from wattline.settings import TARGETS


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quantile_bins_are_found_without_running_through_all_cuts(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=3000), np.full(500, 0.25)])
    df = spark.createDataFrame([(str(i % 2), float(x)) for i, x in enumerate(v)], "k string, v double")
    probs = [0.0, 0.05, 0.5, 0.95, 0.999, 1.0]
    for bins in (2, 17, 256):
        q = exact_quantiles(df, ["k"], "v", probs, bins=bins, names=[f"q{i}" for i in range(len(probs))])
        assert "lambda" not in plan(q)
        for r in q.collect():
            assert np.allclose([r[f"q{i}"] for i in range(len(probs))], np.quantile(v[int(r["k"])::2], probs))


def test_place_counts_the_cuts_below(spark):
    for n in (0, 1, 2, 3, 8, 9, 15, 16, 255):
        cuts = [float(2 * i) for i in range(n)]
        rows = spark.range(-2, 2 * n + 2).select(F.col("id").cast("double").alias("v"), F.lit(cuts).cast("array<double>").alias("c") if n else F.expr("cast(array() as array<double>)").alias("c"))
        short = rows.withColumn("c", F.slice("c", 1, max(n - 1, 1)))
        for df in (rows, short):
            assert _place(df, "c", "v", n, "b").where("b != size(filter(c, x -> x < v))").count() == 0


def test_catalogue_reads_the_shadow_rows_once(spark):
    rows = [("da", "2001-01-01", 0, "a", 2.0), ("da", "2001-01-01", 0, "a", -3.0), ("da", "2001-01-01", 1, "a", 1.0), ("da", "2001-02-01", 0, "b", 9.0), ("da", "2001-08-01", 0, "b", 50.0),
            ("rt", "2001-01-05", 0, None, 4.0), ("rt", "2001-01-05", None, "c", 1.0), ("rt", "2002-06-30", 0, "c", None)]
    rows = spark.createDataFrame(rows, "market string, d string, hr int, key string, mu double").withColumn("d", F.to_date("d"))
    windows = spark.createDataFrame([(2001, "2001-01-01", "2001-06-30"), (2002, "2002-01-01", "2002-06-30")], "fold int, window_start string, window_end string")
    windows = windows.withColumns({c: F.to_date(c) for c in ("window_start", "window_end")})
    c = constraint_catalogue(rows, windows, 2)
    assert plan(c).count("RDD [market#") == 1
    want = {(2001, "da", "b", 1, 9.0, 1), (2001, "da", "a", 2, 6.0, 2), (2001, "rt", None, 1, 4.0, 1), (2001, "rt", "c", 2, 1.0, 1), (2002, "rt", "c", 1, None, 1)}
    assert {(r["fold"], r["market"], r["key"], r["rank"], r["sum_abs_shadow"], round(r["bind_rate"] * 181 * 24)) for r in c.collect()} == want
    slots = rows.groupBy("market", "d", "hr", "key").agg(F.sum(F.abs("mu")).alias("mu"))
    assert set(constraint_catalogue(slots, windows, 2, one_row_a_slot=True).collect()) == set(c.collect())


def test_constraint_windows_join_lines_of_their_days_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    p = plan(constraint_windows(t))
    assert p.count("Relation [l_orderkey") == 1
    days = spark.createDataFrame([("1997-01-05",), ("1997-03-01",)], "d string").withColumn("d", F.to_date("d"))
    assert shadow(t, days=days).exceptAll(shadow(t).where("d in (date'1997-01-05', date'1997-03-01')")).count() == 0
    assert shadow(t, days=days).count() == shadow(t).where("d in (date'1997-01-05', date'1997-03-01')").count() > 0


class Point:
    """The price of a day before, as a model."""

    def __init__(self, name, price, fails=False):
        self.name, self.price, self.fails = name, price, fails

    def config(self):
        return {"price": self.price}

    def fit_predict(self, panel, folds):
        if self.fails:
            raise RuntimeError("no fit")
        return long_forecast(assign_test_fold(panel, folds), {("da", "total"): F.col("da_total") + self.price}, ["fold"])


def test_runs_over_the_same_folds_share_their_writes(spark, tmp_path):
    days = [date(1999, 1, 1) + timedelta(days=i) for i in range(20)]
    panel = spark.createDataFrame([(d, datetime(d.year, d.month, d.day), z, 0, float(i), True, True) for i, d in enumerate(days) for z in "AB"],
                                  "delivery_date date, ts_utc timestamp, zone string, hour_local int, da_total double, score_da boolean, score_rt boolean")
    panel = panel.withColumns({c: F.lit(None).cast("double") for c in TARGETS if c != "da_total"})
    folds = [Fold(str(i), days[0], days[i - 1], days[i], days[i + 4]) for i in (5, 10)]
    reg = Registry(spark, str(tmp_path / "r"))
    a, b = backtest.run_all(reg, [Point("one", 1.0), Point("two", 2.0)], panel, folds)
    assert len(list((tmp_path / "r" / "predictions" / "rows").glob("generation=*"))) == len(list((tmp_path / "r" / "scores" / "rows").glob("generation=*"))) == 1
    for run_id, off in ((a, 1.0), (b, 2.0)):
        p = reg.predictions(run_id)
        assert p.count() == 16 and p.where(F.col("mean") - F.col("y") != off).count() == 0
        mae = reg.scores().where((F.col("run_id") == run_id) & (F.col("metric") == "mae")).select("fold", "zone", "value").collect()
        assert len(mae) == 6 and {r["value"] for r in mae} == {off}
    runs = {r["model"]: r for r in reg.runs().collect()}
    assert {m: (r["run_id"], r["status"], r["panel_rows"], '"price"' in r["config_json"]) for m, r in runs.items()} == {"one": (a, "done", 40, True), "two": (b, "done", 40, True)}
    assert runs["one"]["panel_hash"] == runs["two"]["panel_hash"] and reg.panel_of(b).count() == 40
    with pytest.raises(RuntimeError, match="no fit"):
        backtest.run_all(reg, [Point("three", 3.0), Point("four", 4.0, fails=True)], panel, folds)
    assert {r["model"]: r["status"] for r in reg.runs().collect()} == {"one": "done", "two": "done", "three": "failed", "four": "failed"}
