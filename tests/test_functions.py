from datetime import date, datetime
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.functions import clock, names, numeric
from wattline.functions import quantiles as Q
from wattline.functions.calendar import holidays_of
from wattline.operators import kernels
from wattline.settings import QCOLS, QUANTILES


def test_local_to_utc(spark):
    rows = [("2025-11-02 01:30:00", False), ("2025-11-02 01:30:00", True), ("2025-03-09 02:30:00", False), ("2025-07-01 12:00:00", True)]
    df = spark.createDataFrame(rows, "t string, std boolean").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = [r[0] for r in df.select(clock.local_to_utc(F.col("t"), standard=F.col("std")).cast("timestamp_ntz")).collect()]
    assert got == [datetime(2025, 11, 2, 5, 30), datetime(2025, 11, 2, 6, 30), datetime(2025, 3, 9, 7), datetime(2025, 7, 1, 16)]


def test_day_lengths_and_rounding(spark):
    d = spark.createDataFrame([(date(2025, 3, 9),), (date(2025, 11, 2),), (date(2025, 7, 1),)], "d date")
    assert [r[0] for r in d.select(clock.hours_in_day(F.col("d"))).collect()] == [23, 25, 24]
    t = spark.sql("SELECT explode(array(timestamp'2024-01-01 00:30:00', timestamp'2024-01-01 01:30:00', timestamp'2024-01-01 01:51:00')) t")
    assert [r[0].hour for r in t.select(clock.round_to_hour(F.col("t")).cast("timestamp_ntz")).collect()] == [0, 2, 2]


def test_holidays():
    assert [d for d, _ in holidays_of(2023)] == [date(2023, 1, 2), date(2023, 5, 29), date(2023, 7, 4), date(2023, 9, 4), date(2023, 11, 23), date(2023, 12, 25)]


def test_normal_functions(spark):
    xs = [-9.0, -3.3, -1.0, 0.0, 0.4, 2.5, 8.0]
    ps = [1e-6, 0.01, 0.3, 0.5, 0.975, 1 - 1e-6]
    cdf = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(numeric.norm_cdf(F.col("x"))).collect()]
    ppf = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(numeric.norm_ppf(F.col("p"))).collect()]
    assert np.allclose(cdf, [NormalDist().cdf(x) for x in xs], atol=1e-12)
    assert np.allclose(ppf, [NormalDist().inv_cdf(p) for p in ps], atol=1e-8)
    assert np.allclose(kernels.normal_ppf(np.array(ps)), [NormalDist().inv_cdf(p) for p in ps], atol=1e-8)


def test_pit_and_ppf_are_inverse():
    rng = np.random.default_rng(0)
    q = np.sort(rng.normal(size=(200, 21)), axis=1)
    u = np.linspace(0.0005, 0.9995, 41)
    x = kernels.ppf_rows(np.tile(u, (200, 1)), q)
    back = np.column_stack([kernels.pit_rows(x[:, i], q) for i in range(len(u))])
    assert np.allclose(back, u, atol=1e-6)


def test_gpd_fit_recovers_shape():
    rng = np.random.default_rng(1)
    u = rng.random(20_000)
    xi, sigma = kernels.gpd_fit(3.0 / 0.25 * ((1 - u) ** -0.25 - 1))
    assert abs(xi - 0.25) < 0.04 and abs(sigma - 3.0) < 0.15


def test_lasso_path_is_soft_threshold_on_orthogonal_design():
    xy = np.array([[3.0, -0.5], [1.0, 2.0]])
    path = kernels.lasso_paths(np.eye(2), xy, np.array([[2.0, 1.0], [0.5, 0.25]]))
    assert np.allclose(path[0], [[1.0, 0.0], [0.0, 1.0]]) and np.allclose(path[1], [[2.5, -0.25], [0.5, 1.75]])


def test_crps_identities(spark):
    nd = NormalDist()
    rng = np.random.default_rng(2)
    y = rng.normal(size=4000)
    rows = [(float(v), *[nd.inv_cdf(q) for q in QUANTILES]) for v in y]
    df = spark.createDataFrame(rows, ["y", *QCOLS])
    point = spark.createDataFrame([(5.0, *[3.0] * 21)], ["y", *QCOLS])
    assert abs(df.agg(F.avg(Q.crps(F.col("y")))).first()[0] - 0.5642) < 0.02
    assert abs(point.select(Q.crps(F.col("y"))).first()[0] - 2.0) < 0.02
    gap = point.withColumn("q50", F.lit(None).cast("double")).select(Q.crps(F.col("y"))).first()[0]
    assert gap is None


def test_station_tokens(spark):
    df = spark.createDataFrame([("ASTORIAE-CORONA___138_34183", "SCH - NE - NY | BASE CASE", "ASTANNEX 138 ASTORIAE 138 1 | SCB:SPBK(RNS5):Y49&M29"), ("SCH-PJM-NY_LIMIT_1700", "GENT   345 LEED   345 1 | NY:MOSES--ADIRON", "x | y")], "e string, k string, c string")
    e, k, f, c = df.select(names.equipment_tokens(F.col("e")), names.facility_tokens(F.col("k")), names.facility_tokens(F.col("c")), names.contingency_tokens(F.col("c"))).first()
    assert sorted(e) == ["ASTORIAE", "CORONA"] and k == ["SCH:NE"] and sorted(f) == ["ASTANNEX", "ASTORIAE"] and c == ["SPBK"]
    assert df.select(names.equipment_tokens(F.col("e"))).collect()[1][0] == ["SCH:PJ"]


def test_hash_uniform_is_stable_and_uniform(spark):
    a = spark.range(20_000).select(numeric.hash_uniform(F.col("id"), seed=3).alias("u"))
    b = spark.range(20_000).repartition(7).select(F.col("id"), numeric.hash_uniform(F.col("id"), seed=3).alias("u"))
    assert abs(a.agg(F.avg("u")).first()[0] - 0.5) < 0.01
    assert a.agg(F.sum("u")).first()[0] == pytest.approx(b.agg(F.sum("u")).first()[0])
