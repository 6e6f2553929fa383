"""Structure tables: the network as estimated fold by fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.ordered import top_per_group
from wattline.operators.sparse import cobinding, key_drift, matrix_drift, subspace_drift

SLOT = ["d", "hr"]


def window_days(windows: DataFrame) -> DataFrame:
    """The windows laid out on days: folds x calendar days."""
    return windows.withColumn("d", F.explode(F.sequence("window_start", "window_end")))


def constraint_catalogue(shadow: DataFrame, windows: DataFrame, k: int = 60, one_row_a_slot: bool = False) -> DataFrame:
    """(fold, market, key, rank, sum_abs_shadow, bind_rate, window_start, window_end).

    `windows` (fold, window_start, window_end) is laid out on days and sent to the shadow rows; one pass over them gives sums and hours.  `one_row_a_slot` says
    that shadow has no two rows of one market, key and slot, so that the slots are counted without being told apart once more.
    """
    inside = shadow.join(F.broadcast(window_days(windows)), "d")
    hours = F.count(F.lit(1)) if one_row_a_slot else F.count_distinct(F.struct(*SLOT))
    sums = inside.groupBy("fold", "market", "key", "window_start", "window_end").agg(F.sum(F.abs("mu")).alias("sum_abs"), hours.alias("_h"))
    top = top_per_group(sums, ["fold", "market"], [F.desc("sum_abs"), F.asc("key")], k)
    span = (F.datediff("window_end", "window_start") + 1) * 24
    return top.select("fold", "market", "key", "rank", F.col("sum_abs").alias("sum_abs_shadow"), (F.col("_h") / span).alias("bind_rate"), "window_start", "window_end")


def build(shadow: DataFrame, catalogue: DataFrame, zone_factors: DataFrame, node_factors: DataFrame, node_fit: DataFrame, nodes: DataFrame, k: int = 60,
          min_both: int = 24) -> dict[str, DataFrame]:
    """The seven output tables from a structural run's artifacts."""
    days = catalogue.select("fold", "market", "window_start", "window_end").distinct().withColumn("d", F.explode(F.sequence("window_start", "window_end")))
    inside = shadow.join(days.select("fold", "market", "d"), ["market", "d"]).select("fold", "market", *SLOT, "key")
    by = ["market"]
    drift = key_drift(catalogue, by, "fold", "key")
    for df, row, inner, name in ((zone_factors, "zone", False, "zone_sf_rel_change"), (node_factors, "ptid", True, "node_sf_rel_change")):
        drift = drift.join(matrix_drift(df, by, "fold", row, "key", inner_rows=inner, out=name), [*by, "fold"], "left")
    drift = drift.join(subspace_drift(node_factors, by, "fold", "ptid", "key").withColumnRenamed("angle_deg", "node_subspace_angle_deg"), [*by, "fold"], "left")
    return {"constraint_catalog": catalogue, "zone_shift_factors": zone_factors, "node_shift_factors": node_factors, "node_fit": node_fit,
            "cobinding": cobinding(inside, catalogue, ["fold", "market"], SLOT, "key", k, min_both), "drift": drift,
            "node_meta": nodes.select("ptid", "name", "zone", "lat", "lon")}
