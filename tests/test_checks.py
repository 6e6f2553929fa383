"""Registered queries ask for the operators' whole job."""

import functools
import inspect

from pyspark.sql import functions as F

from wattline.checks import registered_queries, statistics, trade
from wattline.plans import paths, pricing

ROOT = "/root/testdata/sf0.001"


def heard(monkeypatch, module, name, default):
    """Values of `default` that calls of module.name would have run with."""
    seen, fn = [], getattr(module, name)

    @functools.wraps(fn)
    def call(*args, **kw):
        bound = inspect.signature(fn).bind(*args, **kw)
        bound.apply_defaults()
        seen.append(bound.arguments[default])
        return fn(*args, **kw)

    monkeypatch.setattr(module, name, call)
    return seen


def test_trade_queries_use_the_operators_defaults(spark, monkeypatch):
    seen = [heard(monkeypatch, m, f, a) for m, f, a in ((pricing, "backtest", "k"), (pricing, "spread_forecast", "k"), (pricing, "null_table", "draws"), (paths, "summarise", "draws"), (paths, "summarise", "baselines"))]
    methods = heard(monkeypatch, pricing, "spread_forecast", "method")
    for name in ("bid_curve_backtest", "bid_curve_backtest_copula", "joint_scenarios", "joint_scenarios_gauss", "joint_scenarios_emp", "shuffled_outcome_null", "path_summary"):
        registered_queries()[name](spark, ROOT)
    assert [set(x) for x in seen] == [{500}, {500}, {500}, {4000}, {("c", "persistence", "climatology")}]
    assert methods == ["indep", "gauss", "emp"]


def test_scenario_queries_reach_the_first_folds(spark):
    t = trade.Tables(spark, ROOT)
    assert trade._wide(t).agg(F.min("delivery_date")).first()[0].year < 2000


def test_bootstrap_queries_use_the_operators_defaults(spark, monkeypatch):
    draws, sims = heard(monkeypatch, statistics, "cluster_bootstrap", "draws"), heard(monkeypatch, statistics, "power_curve", "sims")
    for name in ("cluster_bootstrap", "forward_power_curve"):
        registered_queries()[name](spark, ROOT)
    assert draws == [4000] and sims == [2000]


def test_the_book_is_joined_once_a_query(spark):
    t = trade.Tables(spark, ROOT)
    assert t.book() is t.book()
    plan = t.book().join(t.lagged_book(), ["d", "zone"])._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and t.book().count() > 0


def test_constraints_outside_the_catalogue_are_not_joined(spark):
    from wattline.checks import network

    t = trade.Tables(spark, ROOT)
    c = network.catalogue(t).select("fold", "market", "key", (F.col("rank") - 1).cast("int").alias("c"))
    want = network.shadow(t).withColumn("fold", F.year("d")).join(c, ["fold", "market", "key"])
    got = network.indexed(t)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_rows_meet_small_tables_where_they_are(spark, monkeypatch):
    """Points of a band and lines of a flag are not gathered in one task for their join."""
    for name, key in (("points_in_areas", "_band"), ("components_and_transform", "l_returnflag")):
        plan = registered_queries()[name](spark, ROOT)._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan, key
