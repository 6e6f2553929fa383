from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.models import congestion as C
from wattline.models import lear, loadfix, spike
from wattline.models.lear import LearModel
from wattline.models.naive import NaiveModel
from wattline.models.trees import BoostedModel
from wattline.plans import backtest, live, monthly, paths, pricing, trading
from wattline.plans.folds import Fold
from wattline.plans.panel import FEATURES
from wattline.plans.registry import Registry
from wattline.settings import COMPONENTS, QCOLS, QUANTILES

START, DAYS = date(2024, 6, 1), 70
ZONES = ["CAPITL", "WEST"]
FOLDS = [Fold("a", START, date(2024, 7, 25), date(2024, 8, 1), date(2024, 8, 5)), Fold("b", START, date(2024, 7, 29), date(2024, 8, 5), date(2024, 8, 9))]


@pytest.fixture(scope="module")
def panel(spark):
    """Two zones; tomorrow's price follows the load forecast and yesterday's price."""
    rng = np.random.default_rng(0)
    rows = []
    for z, zone in enumerate(ZONES):
        load = 1000 + 200 * rng.random((DAYS, 24)) + 100 * np.sin(np.arange(24) / 4)
        da = 20 + 0.03 * load + rng.normal(0, 1, (DAYS, 24)) + 5 * z
        rt = da + rng.standard_t(3, (DAYS, 24)) * 3
        for i in range(DAYS):
            d = START + timedelta(days=i)
            for h in range(24):
                r = {c: float(rng.normal()) for c in FEATURES}
                r |= {"delivery_date": d, "ts_utc": pd.Timestamp(d) + pd.Timedelta(hours=h + 4), "ts_local": pd.Timestamp(d) + pd.Timedelta(hours=h), "zone": zone, "hour_local": h, "hour_index": h, "n_hours": 24,
                      "dow": d.isoweekday(), "month": d.month, "is_weekend": d.isoweekday() > 5, "is_holiday": False, "load_fcst_zone": load[i, h], "load_fcst_system": load[i, h] * 2, "gas_hh": 3.0,
                      "score_da": True, "score_rt": True, "hrrr_temp_zone": 20 + rng.normal(), "temp_fcst_zone_file": 20.0}
                for m, v in (("da", da), ("rt", rt)):
                    for c, k in zip(COMPONENTS, (1.0, 0.8, 0.05, 0.15)):
                        r[f"{m}_{c}"] = v[i, h] * k
                for tag, v, lag in (("da_d1", da, 1), ("da_d7", da, 7), ("rt_d2", rt, 2)):
                    for c, k in zip(COMPONENTS, (1.0, 0.8, 0.05, 0.15)):
                        r[f"lag_{tag}_{c}"] = float(v[i - lag, h] * k) if i >= lag else None
                rows.append(r)
    pdf = pd.DataFrame(rows)
    df = spark.createDataFrame(pdf).withColumn("delivery_date", F.to_date("delivery_date"))
    fixed = {c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t == "double"}
    return df.withColumns(fixed).withColumns({c: F.col(c).cast("int") for c in ("hour_local", "hour_index", "n_hours", "dow", "month")}).repartition(4).cache()


def mae(pred, panel, market="da", component="total"):
    j = backtest.join_truth(pred, panel).filter((F.col("market") == market) & (F.col("component") == component))
    return j.agg(F.avg(F.abs(F.col("mean") - F.col("y")))).first()[0]


def test_lear_beats_persistence_and_ignores_the_future(spark, panel):
    panel = panel.filter("zone = 'CAPITL'")
    base = mae(NaiveModel("persist_da_d1").points(panel.filter("delivery_date BETWEEN DATE'2024-08-01' AND DATE'2024-08-04'")), panel)
    m = LearModel("lear2", (None,), "holdout")
    pred = m.fit_predict(panel, FOLDS[:1]).cache()
    assert pred.count() == 2 * 4 * 4 * 24 and mae(pred, panel) < 0.75 * base
    cut = panel.withColumns({f"{k}_{c}": F.when(F.col("delivery_date") >= F.lit(date(2024, 8, 1)), 999.0).otherwise(F.col(f"{k}_{c}")) for k in ("da", "rt") for c in COMPONENTS})
    first = lambda p: p.filter("delivery_date = DATE'2024-08-01' AND component = 'total'").groupBy("market").agg(F.round(F.sum("mean"), 6).alias("s")).orderBy("market").collect()          # noqa: E731
    assert first(m.fit_predict(cut, FOLDS[:1])) == first(pred)


def test_information_criterion_keeps_the_signal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 30))
    z = np.column_stack([2 * x[:, 0] - x[:, 3] + rng.normal(0, 0.5, 200), rng.normal(0, 1, 200)])
    b = lear._aic_fit(x - x.mean(axis=0), z - z.mean(axis=0))
    assert abs(b[0, 0] - 2) < 0.2 and abs(b[3, 0] + 1) < 0.2 and (b[:, 1] != 0).sum() < 15


def test_boosted_trees(spark, panel):
    m = BoostedModel("l2", n_trees=8, depth=3, learning_rate=0.4, min_rows=10, zones=ZONES)
    pred = m.fit_predict(panel.filter("hour_local < 6"), FOLDS[:1])
    assert pred.filter("mean IS NULL").count() == 0 and pred.count() == 2 * 4 * 4 * 12
    assert mae(pred, panel) < 3.5


def test_naive_run_is_logged_and_scored(spark, panel, tmp_path):
    reg = Registry(spark, str(tmp_path / "r"))
    rid = backtest.run(reg, NaiveModel("persist_da_d1"), panel, FOLDS, NaiveModel("lago_naive").points(panel))
    s = reg.scores().filter("metric = 'crps' AND zone = 'ALL' AND component = 'total'").collect()
    assert len(s) == 4 and all(0 < r["value"] < 10 for r in s) and reg.latest_runs().first()["run_id"] == rid
    p = reg.predictions(rid)
    cov = p.filter("component = 'total' AND market = 'da'").agg(F.avg(F.col("y").between(F.col("q05"), F.col("q95")).cast("double"))).first()[0]
    assert 0.75 < cov <= 1.0
    hist = p.drop("run_id", "fold")
    today = NaiveModel("persist_da_d1").points(panel.filter("delivery_date = DATE'2024-08-09'"))
    rows = live.day_forecast({"gbm_l1": hist, "lear_clip": hist}, {"gbm_l1": today, "lear_clip": today}, panel.filter("delivery_date <= DATE'2024-08-09'"), date(2024, 8, 9), "combo3_eq_aci")
    assert rows.count() == 8 * 48 and rows.filter("mean IS NULL").count() == 0
    live.publish(reg, "live_forecasts", rows)
    assert reg.live("live_forecasts").count() == 8 * 48


def test_load_correction(spark, panel):
    p = panel.withColumn("hrrr_cloud_zone", F.lit(50.0))
    load = p.select("ts_utc", "zone", (F.col("load_fcst_zone") * (1 + 0.02 * (F.col("hrrr_temp_zone") - 20))).alias("load_mw"))
    d = loadfix.frame(p, load, p.select("ts_utc", "zone", F.col("load_fcst_zone").alias("load_forecast_mw")), ZONES)
    pred = loadfix.debias(loadfix.linear_correction(d, FOLDS), d, FOLDS)
    s = {r["zone"]: r for r in loadfix.load_scores(pred, [], 2).collect()}
    assert set(s) == {"CAPITL", "WEST", "ALL", "SYSTEM"} and s["ALL"]["rmse"] < 0.2 * s["ALL"]["rmse_isolf_d2"]
    t = loadfix.tree_correction(d.filter("hour_local < 4"), FOLDS[:1], n_trees=4, depth=3, learning_rate=0.5, zones=ZONES, min_rows=5)
    assert t.agg(F.corr("r_hat", "r")).first()[0] > 0.7
    assert loadfix.oos_table(pred, "x").columns == ["ts_utc", "zone", "delivery_date", "load_fix", "r_hat", "run_id"] and len(loadfix.oos_folds()) == 36


def test_spike_member(spark, panel):
    p = panel.withColumn("rt_total", F.when(F.col("gas_hh") + F.col("rt_spin_max_24h") > 4.5, F.col("rt_total") + 60).otherwise(F.col("rt_total")))
    m = spike.SpikeModel("no_storm", ZONES, penalties=(0.1,))
    pred = m.fit_predict(p, FOLDS[:1]).cache()
    q = pred.agg(F.avg(F.when(F.col("spike") == 1, F.col("p_spike"))).alias("a"), F.avg(F.when(F.col("spike") == 0, F.col("p_spike"))).alias("b"), F.min(F.col("q99") - F.col("q01")).alias("w")).first()
    assert q["a"] > 2 * q["b"] and q["w"] > 0
    tr, _, _ = spike.labelled(spike.frame(p, ZONES), FOLDS[:1])
    s = spike.spike_scores(pred, spike.climatology(tr)).filter("zone = 'ALL'").first()
    assert s["brier"] < s["brier_clim"] and s["logloss"] < s["logloss_clim"]


def test_structural_congestion(spark):
    """Two constraints drive two zones through known factors; the factors and the forecast must show it."""
    rng = np.random.default_rng(4)
    a = {"K1 | B": {"A": 1.0, "B": 0.2}, "K2 | B": {"A": -0.5, "B": 0.8}}
    sh, cg, sysrows = [], [], []
    for i in range(120):
        d = date(2024, 1, 1) + timedelta(days=i)
        for h in range(24):
            mu = {k: float(rng.random() < (0.7 if h in (17, 18, 19) else 0.05)) * (20 + rng.random()) for k in a}
            for m in ("da", "rt"):
                sh += [(m, d, h, k, v) for k, v in mu.items() if v]
                cg += [(m, d, h, z, sum(a[k][z] * mu[k] for k in a) + float(rng.normal(0, 0.05))) for z in ("A", "B")]
            sysrows.append((d, h, 100.0, 20.0, 3.0, d.isoweekday(), d.month))
    src = {"shadow": spark.createDataFrame(sh, "market string, d date, hr int, key string, mu double").cache(), "congestion": spark.createDataFrame(cg, "market string, d date, hr int, zone string, cong double").cache(),
           "system": spark.createDataFrame(sysrows, "d date, hr int, load_fcst_system double, temp_fcst_system double, gas_hh double, dow int, month int").cache(),
           "outages": spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), 1) for i in range(120)], "d date, n_outages int").cache()}
    fold = Fold("f", date(2024, 1, 1), date(2024, 4, 10), date(2024, 4, 17), date(2024, 4, 20))
    pred, art = C.StructuralModel(k=2, window_days=50, n_trees=3, depth=3).fit_predict_fold(src, fold)
    f = {(r["zone"], r["key"]): r["a"] for r in art["zone_shift_factors"].filter("market = 'da'").collect()}
    assert all(abs(f[(z, k)] - v) < 0.05 for k in a for z, v in a[k].items())
    j = pred.join(src["congestion"], ["market", "d", "hr", "zone"])
    assert pred.count() == 2 * 3 * 24 * 2 and j.agg(F.corr("mean", "cong")).first()[0] > 0.4
    s = C.binding_scores(art["constraint_forecasts"], ["market"]).first()
    assert s["logloss"] < 0.7 and s["brier"] < 0.25


def test_pricer_finds_edge_and_not_noise():
    rng = np.random.default_rng(5)
    da = rng.normal(40, 5, (50, 400))
    edge, fair = pricing.price_draws(da, da - 6 + rng.normal(0, 4, da.shape), "bidcurve"), pricing.price_draws(da, da + rng.normal(0, 4, da.shape), "taker")
    assert (edge["side"] == 1).all() and (edge["x_pre"] > 0).all() and (edge["p_clear"] > 0.9).all()
    assert (fair["side"] == 0).mean() > 0.8 and fair.loc[fair["side"] == 0, "x_pre"].max() == 0


def test_scenarios_recover_dependence(spark):
    rng = np.random.default_rng(6)
    n, rho = 1200, 0.7
    z = rng.multivariate_normal([0, 0], [[1, rho], [rho, 1]], n)
    q = [float(np.quantile(rng.normal(size=200_000), p)) for p in QUANTILES]
    rows = [(date(2024, 1, 1) + timedelta(days=i // 20), pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), "A", i % 20, float(a), float(b), *q, *q) for i, (a, b) in enumerate(z)]
    w = spark.createDataFrame(rows, ["delivery_date", "ts_utc", "zone", "hour_local", "y_da", "y_rt", *[f"da_{c}" for c in QCOLS], *[f"rt_{c}" for c in QCOLS]])
    f = [Fold("x", date(2024, 1, 1), date(2024, 2, 15), date(2024, 2, 20), date(2024, 3, 1))]
    r = pricing.copula_rho(pricing.with_pit(w), f).first()
    assert abs(r["rho"] - rho) < 0.06
    width = {m: pricing.spread_forecast(w, f, m, 300).agg(F.avg(F.col("q95") - F.col("q05"))).first()[0] for m in ("gauss", "emp", "indep")}
    assert width["gauss"] < 0.75 * width["indep"] and abs(width["gauss"] - width["emp"]) < 0.25
    a, b = (pricing.spread_forecast(w.repartition(k), f, "gauss", 50).agg(F.sum("mean")).first()[0] for k in (1, 7))
    assert a == pytest.approx(b, abs=1e-9)


def test_forward_record_states(spark):
    d = [date(2025, 1, 1) + timedelta(days=i) for i in range(30)]
    daily = spark.createDataFrame([(x, 1.0 + (i % 3) * 0.1) for i, x in enumerate(d)], "delivery_date date, pnl double")
    assert trading.forward_state(daily, d[0], d[-1], n=40).first()["status"] == "waiting"
    done = trading.forward_state(daily, d[0], d[-1], n=20, draws=200).first()
    assert done["status"] == "scored" and done["p_value"] < 0.05 and done["n_days"] == 20
    assert trading.forward_state(daily, date(2024, 1, 1), d[-1], n=20, draws=50).first()["status"] == "invalid"


def test_monthly_vintage_and_path_hours(spark):
    assert monthly.latest_vintage(date(2026, 3, 20)) == (date(2026, 2, 22), date(2026, 3, 1)) and monthly.latest_vintage(date(2026, 3, 26))[1] == date(2026, 4, 1)
    from wattline.functions.clock import hours_between_days

    d = spark.createDataFrame([(date(2025, 3, 1), date(2025, 3, 31)), (date(2025, 11, 1), date(2025, 11, 30))], "a date, b date")
    assert [r[0] for r in d.select(hours_between_days(F.col("a"), F.col("b"))).collect()] == [743, 721]


def test_structural_path_payoff(spark):
    """One constraint binds every hour at 10 and moves point 2 by +1, point 1 by 0: a path earns 10 an hour."""
    rows, cg = [], []
    for i in range(370):
        d = date(2024, 1, 1) + timedelta(days=i)
        for h in range(24):
            mu = 5.0 + (h % 3) * 5
            rows.append((d, h, "K", mu))
            cg += [(d, h, 1, 0.0), (d, h, 2, mu)]
    sp = spark.createDataFrame(rows, "d date, hr int, key string, mu double")
    cong = spark.createDataFrame(cg, "d date, hr int, ptid int, cong double")
    p = spark.createDataFrame([(1, 1, 1, 2, date(2025, 1, 7), date(2025, 2, 1), date(2025, 2, 28))], "round_id int, period_id int, poi int, pow int, posted date, start date, end date")
    r = paths.structural_payoff(p, sp, cong, k=1).first()
    assert r["struct_trailing"] == pytest.approx(10 * 672, rel=0.01) and r["struct_seasonal"] == pytest.approx(10 * 672, rel=0.01) and r["struct_blend"] is not None


def test_node_rows_are_not_moved_once_a_fold(spark):
    """A node's rows are copied to the folds of its windows inside the task that holds the node."""
    from datetime import date

    from wattline.plans.folds import monthly_folds
    from wattline.plans.nodes import node_coefficients

    hours = spark.range(0, 400).selectExpr("id", "timestamp'2023-01-01' + make_interval(0, 0, 0, cast(id as int)) AS ts_utc")
    prices = hours.selectExpr("ts_utc", "cast(ts_utc as timestamp_ntz) AS ts_local", "id % 3 AS ptid", "cast(id % 7 as double) AS mlc", "cast(id % 5 as double) AS mcc")
    zones = hours.selectExpr("ts_utc", "'A' AS zone", "cast(id % 7 as double) / 2 AS da_mlc", "cast(id % 5 as double) / 4 AS da_mcc")
    nodes = spark.range(0, 3).selectExpr("id AS ptid", "'A' AS zone")
    g = node_coefficients(prices, nodes, zones, "da", monthly_folds(date(2024, 1, 1), date(2024, 4, 1), origin=date(2020, 1, 1)), min_obs=5)
    assert "hashpartitioning(fold" not in g._jdf.queryExecution().executedPlan().toString()
    rows = g.collect()
    assert rows and all(r["b_loss"] == pytest.approx(2.0) and r["b_cong"] == pytest.approx(4.0) for r in rows if r["n_obs"] >= 5)
