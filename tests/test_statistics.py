from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.operators import overfit as O
from wattline.operators import sparse
from wattline.operators.ordered import exact_quantiles
from wattline.operators.resampling import bootstrap_mean_p, cluster_bootstrap, shuffle_within
from wattline.operators.significance import clustered_slope, diebold_mariano, kupiec
from wattline.plans import folds as fd
from wattline.plans import postprocess as P
from wattline.plans.registry import EXPLORATORY, Event, Registry, Table
from wattline.settings import QCOLS, QUANTILES

D0 = date(2022, 1, 1)


def days(n):
    return [D0 + timedelta(days=i) for i in range(n)]


def test_fold_calendar():
    f = fd.monthly_folds()
    assert len(f) == 36 and f[0].test_start == date(2022, 10, 1) and all((x.test_start - x.train_end).days == 7 for x in f)
    assert all(i.test_end <= f[20].train_end for i in fd.inner_folds(f[20])) and len(fd.inner_folds(f[20])) == 3
    with pytest.raises(fd.HoldoutLocked):
        fd.guard(date(2026, 1, 1))
    fd.guard(date(2026, 12, 1))


def test_deflated_sharpe_published_example(spark):
    one = spark.range(1)
    sr, n = F.lit(2.5 / np.sqrt(250)), F.lit(1250)
    sr0 = O.expected_max_sr(F.lit(0.5 / 250), F.lit(100.0))
    r = one.select(sr0.alias("a"), O.dsr(sr, n, F.lit(-3.0), F.lit(10.0), F.lit(0.5 / 250), F.lit(100.0)).alias("b")).first()
    assert r.a == pytest.approx(0.1132, abs=2e-4) and r.b == pytest.approx(0.9004, abs=2e-3)


def skill(spark, edge, trials=6, n=256, seed=0, centred=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, trials))
    x = x - x.mean(axis=0) if centred else x
    x[:, 0] += edge
    rows = [(d, f"t{j}", float(x[i, j])) for i, d in enumerate(days(n)) for j in range(trials)]
    return spark.createDataFrame(rows, "day date, trial string, value double")


def test_overfitting_null_and_planted_edge(spark):
    # with the full-sample means removed, whatever wins in one half must lose in the other
    noise = O.pbo(skill(spark, 0.0, centred=True), 8).first()["pbo"]
    edge = O.pbo(skill(spark, 1.0), 8).first()
    assert noise > 0.8 and edge["pbo"] < 0.02 and edge["prob_oos_loss"] < 0.02
    p = O.spa_test(skill(spark, 0.6, 3), 300).first()
    q = O.spa_test(skill(spark, -0.3, 2, seed=4).filter("trial = 't0'"), 300).first()
    assert p["p_spa_consistent"] < 0.02 and q["p_spa_consistent"] > 0.5
    assert p["p_spa_lower"] <= p["p_spa_consistent"] <= p["p_spa_upper"]


def test_adjustments(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    r = {x["k"]: x for x in O.bhy(O.holm(p, [], "p", "k"), [], "p", "k").collect()}
    assert r["a"]["p_holm"] == pytest.approx(0.03) and r["b"]["p_holm"] == pytest.approx(0.06) and r["c"]["p_holm"] == pytest.approx(0.06)
    assert r["a"]["p_bhy"] == pytest.approx(0.01 * 3 * (11 / 6))


def test_diebold_mariano_against_numpy(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(0.1, 1, 300)
    df = spark.createDataFrame([(t, float(v), 0.0) for t, v in zip(days(300), d)], "day date, a double, b double")
    r = diebold_mariano(df, [], "day", "a", "b").first()
    c = d - d.mean()
    lag = int(300 ** (1 / 3))
    v = c @ c / 300 + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / 300 for k in range(1, lag + 1))
    assert r["dm_stat"] == pytest.approx(d.mean() / np.sqrt(v / 300), rel=1e-9)


def test_kupiec_and_bootstrap(spark):
    rng = np.random.default_rng(5)
    hit = spark.createDataFrame([(bool(x),) for x in rng.random(5000) < 0.1], "m boolean")
    assert kupiec(hit, [], F.col("m"), 0.1).first()["p_value"] > 0.01 and kupiec(hit, [], F.col("m"), 0.2).first()["p_value"] < 1e-6
    s = lambda mu: spark.createDataFrame([(t, float(v)) for t, v in zip(days(200), rng.normal(mu, 1, 200))], "d date, x double")     # noqa: E731
    assert bootstrap_mean_p(s(0.5), [], "d", "x", 400).first()["p_value"] < 0.02 and bootstrap_mean_p(s(-0.2), [], "d", "x", 400).first()["p_value"] > 0.3


def test_cluster_tools(spark):
    rng = np.random.default_rng(6)
    g = np.repeat(np.arange(40), 25)
    x = rng.normal(size=1000)
    y = 0.7 * x + rng.normal(size=40)[g] + rng.normal(size=1000)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y)], "g int, x double, y double")
    r = clustered_slope(df, [], "x", "y", "g").first()
    X = np.column_stack([np.ones(1000), x])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    u = y - X @ b
    bread = np.linalg.inv(X.T @ X)
    meat = sum(np.outer(X[g == k].T @ u[g == k], X[g == k].T @ u[g == k]) for k in range(40))
    assert r["slope"] == pytest.approx(b[1]) and r["se"] == pytest.approx(np.sqrt((bread @ meat @ bread)[1, 1]))
    bs = cluster_bootstrap(df.withColumn("pnl", F.col("y") + 1), [], "g", "pnl", 300).first()
    assert bs["lo"] < bs["mean"] < bs["hi"] and bs["n_trades"] == 1000 and bs["p"] < 0.05
    mixed = shuffle_within(df.withColumn("i", F.monotonically_increasing_id()), ["g"], ["i"], ["y"], 3)
    a = mixed.groupBy("b", "g").agg(F.sum("y").alias("s")).join(df.groupBy("g").agg(F.sum("y").alias("t")), "g")
    assert a.filter("abs(s - t) > 1e-9").count() == 0 and mixed.join(df, ["g", "x", "y"], "left_anti").count() > 1000


def test_cluster_bootstrap_of_pieces(spark, monkeypatch):
    """Clusters dealt over several rows give the draws of a table with one row a pick."""
    from wattline.functions.numeric import hash_uniform
    from wattline.operators import resampling

    df = spark.createDataFrame([(g, c, float((c * 37 + i * 11) % 23) - 9.0 if c % 5 else None) for g, k in (("a", 17), ("b", 5)) for c in range(k) for i in range(c % 3 + 1)], "g string, c int, pnl double")
    each = df.groupBy("g", "c").agg(F.sum(F.coalesce("pnl", F.lit(0.0))).alias("t"), F.count("pnl").alias("n"))
    picks = each.select("g", "c", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("b")).withColumn("k", F.when(F.col("g") == "a", 17).otherwise(5))
    picks = picks.select("g", "b", F.floor(hash_uniform(F.col("g"), F.col("b"), F.col("c"), seed=3) * F.col("k")).cast("int").alias("c"))
    m = picks.join(each, ["g", "c"]).groupBy("g", "b").agg((F.sum("t") / F.sum("n")).alias("m"))
    want = {r["g"]: (r["lo"], r["hi"]) for r in m.groupBy("g").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi")).collect()}
    for piece in (3, resampling.CLUSTER_PIECE):
        monkeypatch.setattr(resampling, "CLUSTER_PIECE", piece)
        got = {r["g"]: (r["lo"], r["hi"]) for r in cluster_bootstrap(df, ["g"], "c", "pnl", 50, 3).collect()}
        assert set(got) == {"a", "b"} and all(got[g] == pytest.approx(want[g]) for g in want)


def test_permutations_move_no_row_a_draw(spark):
    """Rows of a group meet in the array that holds them: no join of all rows of all draws, which Spark may try to broadcast."""
    df = spark.createDataFrame([(a, f"p{i}", float(a * 10 + i), i) for a in range(3) for i in range(a + 4)], "a int, p string, s double, c int")
    mixed = shuffle_within(df, ["a"], ["p"], ["s"], 70, 1)
    assert "Join" not in mixed._jdf.queryExecution().optimizedPlan().toString()
    rows = mixed.collect()
    assert len(rows) == 70 * 15 and {(r["a"], r["p"], r["c"]) for r in rows} == {(r["a"], r["p"], r["c"]) for r in df.collect()}
    for b in (1, 64, 65, 70):
        assert sorted(r["s"] for r in rows if r["b"] == b) == sorted(r["s"] for r in df.collect())
    assert len({tuple(r["s"] for r in sorted(rows, key=lambda r: r["p"]) if r["b"] == b and r["a"] == 2) for b in range(1, 71)}) > 40


def test_sparse_algebra_against_numpy(spark):
    rng = np.random.default_rng(7)
    x = np.where(rng.random((200, 5)) < 0.4, rng.normal(size=(200, 5)), 0.0)
    a = rng.normal(size=(5, 2))
    y = x @ a + rng.normal(scale=0.01, size=(200, 2))
    xs = spark.createDataFrame([(t, j, float(x[t, j])) for t in range(200) for j in range(5) if x[t, j]], "o int, c int, v double").repartition(5)
    ys = spark.createDataFrame([(t, f"z{j}", float(y[t, j])) for t in range(200) for j in range(2)], "o int, z string, w double")
    g = np.zeros((5, 5))
    for r in sparse.gram(xs, [], ["o"], "c", "v", 5).collect():
        g[r["i"], r["j"]] = r["v"]
    assert np.allclose(g, np.triu(x.T @ x))
    f = sparse.ridge_factors(xs, ys, [], ["o"], "c", "v", "z", "w", 5, 1.0)
    got = np.zeros((5, 2))
    for r in f.collect():
        got[r["c"], int(r["z"][1])] = r["a"]
    assert np.allclose(got, np.linalg.solve(x.T @ x + np.eye(5), x.T @ y))
    r2 = [r["r2_in_window"] for r in sparse.in_window_r2(xs, ys, f, [], ["o"], "c", "v", "z", "w").collect()]
    assert min(r2) > 0.95


def test_exact_quantiles_with_hot_group_and_ties(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([np.full(4000, 1.0), rng.normal(size=1001)])
    df = spark.createDataFrame([("hot", float(x)) for x in v] + [("one", 5.0)], "k string, v double").repartition(6)
    r = {x["k"]: x for x in exact_quantiles(df, ["k"], "v", [0.05, 0.5, 0.99], bins=16).collect()}
    assert np.allclose([r["hot"]["p05"], r["hot"]["p50"], r["hot"]["p99"]], np.quantile(v, [0.05, 0.5, 0.99])) and r["one"]["p99"] == 5.0


def predictions(spark, n=120, seed=9):
    rng = np.random.default_rng(seed)
    rows = [(d, datetime.combine(d, datetime.min.time()), z, 0, "da", "total", float(m), float(m + e), True, 0.0)
            for z in ("A", "B") for d, m, e in zip(days(n), rng.normal(40, 5, n), rng.normal(0, 3, n))]
    return spark.createDataFrame(rows, "delivery_date date, ts_utc timestamp, zone string, hour_local int, market string, component string, mean double, y double, scored boolean, ref_mean double")


def direct_aci(g, window=365, gamma=0.01, min_obs=30, lag=2):
    """Plain restatement of the rule for one series."""
    lower = np.array([q for q in QUANTILES if q < 0.5])
    alpha, out, pending = 2 * lower, [], []
    t, m, r = g["day"].to_numpy(), g["mean"].to_numpy(), (g["y"] - g["mean"]).to_numpy()
    for i in range(len(g)):
        for p in [p for p in pending if p[0] <= t[i]]:
            alpha = np.clip(alpha + gamma * (2 * lower - ((r[p[1]] < p[2]) | (r[p[1]] > p[3]))), 1e-4, 0.999)
        pending = [p for p in pending if p[0] > t[i]]
        past = r[(t <= t[i] - lag) & (t > t[i] - lag - window)]
        if len(past) < min_obs:
            out.append(np.full(21, np.nan))
            continue
        lo, hi = np.quantile(past, alpha / 2), np.quantile(past, 1 - alpha / 2)
        out.append(m[i] + np.sort(np.r_[lo, np.quantile(past, 0.5), hi]))
        pending.append((t[i] + lag, i, lo, hi))
    return np.array(out)


def test_adaptive_conformal_matches_direct_rule_and_ignores_the_future(spark):
    p = predictions(spark)
    got = P.calibrate_aci(p, window_days=60).filter("zone = 'A'").orderBy("delivery_date").toPandas()
    g = got.assign(day=(pd.to_datetime(got["delivery_date"]) - pd.Timestamp(D0)).dt.days)
    assert np.allclose(got[QCOLS].to_numpy(float), direct_aci(g, 60), equal_nan=True)
    late = P.calibrate_aci(p.withColumn("y", F.when(F.col("delivery_date") >= F.lit(days(120)[100]), 999.0).otherwise(F.col("y"))), window_days=60)
    late = late.filter("zone = 'A'").orderBy("delivery_date").toPandas()
    assert np.allclose(got[QCOLS].to_numpy(float)[:102], late[QCOLS].to_numpy(float)[:102], equal_nan=True)


def test_spike_mixture_limits(spark):
    base = P.calibrate_aci(predictions(spark, 60)).withColumn("market", F.lit("rt")).dropna(subset=QCOLS)
    spike = base.withColumns({c: F.col(c) + 100 for c in QCOLS} | {"mean": F.col("mean") + 100})
    none = P.spike_mixture(base, spike.withColumn("p_spike", F.lit(0.0)))
    full = P.spike_mixture(base, spike.withColumn("p_spike", F.lit(1.0)))
    d = none.join(full.select("ts_utc", "zone", F.col("q50").alias("f50"), F.col("mean").alias("fm")), ["ts_utc", "zone"])
    assert d.filter("abs(fm - mean - 100) > 1e-9 OR f50 - q50 < 90").count() == 0


def test_registry_round_trip(spark, tmp_path):
    r = Registry(spark, str(tmp_path / "reg"))
    panel = predictions(spark, 5)
    with r.running("m", {"k": 1}, panel) as a, r.running("m", {"k": 2}, panel.withColumn("mean", F.col("mean") + 1)) as b:
        assert r.latest_runs().count() == 0
    r.record(Event.of("m", {"k": 3}, EXPLORATORY, error="note"))
    with pytest.raises(ZeroDivisionError), r.running("m", {"k": 1}) as c:
        1 / 0                                                   # noqa: B018
    assert r.runs().filter(F.col("run_id") == c).first()["error"] == "ZeroDivisionError: division by zero"
    assert r.latest_runs().first()["run_id"] == b and r.configs_tried().first()[0] == 3
    assert [x["column"] for x in r.panel_diff(a, b).collect()] == ["mean"] and r.panel_of(a).count() == 10
    r.save_predictions(a, panel.withColumn("fold", F.lit("2022-01")))
    r.save_predictions(b, panel.withColumn("fold", F.lit("2022-01")).drop("ref_mean"))
    r.save_predictions(a, panel.limit(4).withColumn("fold", F.lit("2022-01")))
    assert r.predictions(a).count() == 4 and r.predictions(a, b).count() == 14
    live = panel.select(F.lit("s").alias("signal"), "delivery_date", "zone", "mean")
    r.replace_days("f", live)
    r.replace_days("f", live.filter(F.col("delivery_date") == F.lit(D0)).withColumn("mean", F.lit(-1.0)))
    assert r.live("f").count() == 10 and r.live("f").filter("mean = -1").count() == 2


def test_slots_are_replaced_whole(spark, tmp_path):
    """Readers go by the manifest: a write that died halfway is not seen, and of two writes of one slot only the later one is."""
    t = Table(spark, str(tmp_path / "t"), ("run", "fold"))
    rows = lambda run, fold, n, v: spark.range(n).select(F.lit(run).alias("run"), F.lit(fold).alias("fold"), F.col("id"), F.lit(v).alias("v"))      # noqa: E731
    t.write(rows("a", "x", 3, 1).unionByName(rows("a", "y", 2, 1)))
    rows("a", "x", 9, 7).write.partitionBy("run", "fold").parquet(str(tmp_path / "t/rows/generation=99991231T000000000000-dead"))     # its job never got to the manifest
    seen = lambda: sorted((r["run"], r["fold"], r["v"]) for r in t.read().collect())            # noqa: E731
    assert seen() == [("a", "x", 1)] * 3 + [("a", "y", 1)] * 2
    t.write(rows("a", "y", 1, 2).withColumn("more", F.lit("new column")))
    t.write(rows("b", "x", 1, 3))
    assert seen() == [("a", "x", 1)] * 3 + [("a", "y", 2), ("b", "x", 3)]
    assert t.read(F.col("run") == "a").count() == 4 and {r["more"] for r in t.read().collect()} == {None, "new column"}
    assert t.sweep() == 1 and seen() == [("a", "x", 1)] * 3 + [("a", "y", 2), ("b", "x", 3)]


def test_reads_before_and_after_a_write_in_one_plan(spark, tmp_path):
    """A table read before a write and the same table read after it are different inputs, though they are one folder."""
    t = Table(spark, str(tmp_path / "t"), ("run",))
    rows = lambda run, n: spark.range(n).select(F.lit(run).alias("run"), "id")      # noqa: E731
    t.write(rows("a", 2))
    before = t.read()
    t.write(rows("b", 3))
    after = t.read()
    assert sorted(r["run"] for r in before.unionByName(after).collect()) == ["a"] * 4 + ["b"] * 3
    assert [r["run"] for r in after.join(before, ["run", "id"], "left_anti").collect()] == ["b"] * 3
    t.write(rows("a", 1))
    assert t.read().count() == 4 and t.read("run = 'none'").count() == 0 and t.read("run = 'none'").columns == before.columns
    r = Registry(spark, str(tmp_path / "reg"))
    e = r.record(Event.of("m", {}, "running"))
    first = r.runs()
    r.record(e.then("done"))
    assert sorted(x["status"] for x in first.unionByName(r.runs()).collect()) == ["done", "running"]
