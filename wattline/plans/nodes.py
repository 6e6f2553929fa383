"""Node layer: linear map from a zone's loss and congestion to each node's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.reshape import pivot_values
from wattline.plans.folds import Fold, assign_test_fold, spread_history

WINDOW_DAYS, MIN_OBS = 365, 1000
ROW = ["delivery_date", "ts_utc", "zone"]


def node_coefficients(node_prices: DataFrame, nodes: DataFrame, zone_hourly: DataFrame, market: str, folds: list[Fold], window_days: int = WINDOW_DAYS,
                      min_obs: int = MIN_OBS) -> DataFrame:
    """(fold, ptid, zone, a_loss, b_loss, a_cong, b_cong, n_obs) for all folds in one aggregate; weak nodes get (0, 1).

    The node fact is the large side: it is joined once with the node list and the hourly zone table, then every row is
    counted for the folds whose window holds it.  Rows are dealt by node once, and the zone table (zones x hours, whatever the
    number of nodes) is sent to them, so the copies, up to one for each fold of a window, stay in their task and are never moved.
    """
    j = (node_prices.select("ts_utc", F.to_date("ts_local").alias("delivery_date"), "ptid", F.col("mlc").alias("_nl"), (-F.col("mcc")).alias("_nc")).repartition("ptid")
         .join(nodes.select("ptid", "zone"), "ptid")
         .join(F.broadcast(zone_hourly.select("ts_utc", "zone", F.col(f"{market}_mlc").alias("_zl"), (-F.col(f"{market}_mcc")).alias("_zc"))), ["zone", "ts_utc"]))
    g = spread_history(j, folds, window_days).groupBy("fold", "ptid", "zone").agg(
        F.regr_intercept("_nl", "_zl").alias("a_loss"), F.regr_slope("_nl", "_zl").alias("b_loss"), F.regr_intercept("_nc", "_zc").alias("a_cong"),
        F.regr_slope("_nc", "_zc").alias("b_cong"), F.regr_count("_nl", "_zl").alias("n_obs"))
    strong = F.col("n_obs") >= min_obs
    fix = lambda c, v: F.coalesce(F.when(strong, F.nanvl(c, F.lit(None).cast("double"))), F.lit(v))       # noqa: E731
    return g.withColumns({"a_loss": fix("a_loss", 0.0), "a_cong": fix("a_cong", 0.0), "b_loss": fix("b_loss", 1.0), "b_cong": fix("b_cong", 1.0)})


def node_forecast(zone_fc: DataFrame, coef: DataFrame, market: str, keys: list[str] | None = None) -> DataFrame:
    """Zone component forecasts -> node components and total."""
    keys = keys or []
    z = pivot_values(zone_fc.filter(F.col("market") == market), [*keys, *ROW], "component", ["energy", "loss", "congestion"], "mean")
    out = z.join(coef, [*keys, "zone"])
    out = out.withColumns({"loss": F.col("a_loss") + F.col("b_loss") * F.col("loss"), "congestion": F.col("a_cong") + F.col("b_cong") * F.col("congestion")})
    return out.select(*keys, "delivery_date", "ts_utc", "ptid", "zone", F.lit(market).alias("market"), "energy", "loss", "congestion",
                      (F.col("energy") + F.col("loss") + F.col("congestion")).alias("total"))


def node_scores(zone_fc: DataFrame, coef: DataFrame, node_prices: DataFrame, da_node_prices: DataFrame, market: str, folds: list[Fold]) -> DataFrame:
    """Pooled MAE and RMSE of the node map, the zone forecast used as is, and the node's own day-ahead price a day earlier."""
    fc = assign_test_fold(zone_fc.drop("fold"), folds).drop("train_end")
    mapped = node_forecast(fc, coef, market, ["fold"]).select("ts_utc", "ptid", F.col("total").alias("node_map"))
    plain = coef.withColumns({"a_loss": F.lit(0.0), "a_cong": F.lit(0.0), "b_loss": F.lit(1.0), "b_cong": F.lit(1.0)})
    as_is = node_forecast(fc, plain, market, ["fold"]).select("ts_utc", "ptid", F.col("total").alias("zone_as_node"))
    prev = da_node_prices.select("ptid", (F.col("ts_utc") + F.expr("INTERVAL 1 DAY")).alias("ts_utc"), F.col("lbmp").alias("persist_da_d1"))
    y = node_prices.select("ts_utc", "ptid", F.col("lbmp").alias("y")).join(prev, ["ts_utc", "ptid"], "left")
    j = mapped.join(as_is, ["ts_utc", "ptid"]).join(y, ["ts_utc", "ptid"]).dropna(subset=["y", "node_map", "zone_as_node", "persist_da_d1"])
    rows = F.array(*[F.struct(F.lit(m).alias("model"), (F.col(m) - F.col("y")).alias("e")) for m in ("node_map", "zone_as_node", "persist_da_d1")])
    e = F.col("_r.e")
    return j.select(F.explode(rows).alias("_r")).groupBy(F.lit(market).alias("market"), F.col("_r.model").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
