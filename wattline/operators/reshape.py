"""Pivot and unpivot steps shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.numeric import bind
from wattline.settings import COMPONENTS, MARKETS, QCOLS


def targets_long(panel: DataFrame, value: str = "y") -> DataFrame:
    """Panel targets -> one row per market and component with the market's scoring mask."""
    rows = F.array(*[F.struct(F.lit(m).alias("market"), F.lit(c).alias("component"), F.col(f"{m}_{c}").cast("double").alias(value),
                              F.col(f"score_{m}").alias("scored")) for m in MARKETS for c in COMPONENTS])
    return panel.select("delivery_date", "ts_utc", "zone", "hour_local", F.explode(rows).alias("_r")).select(
        "delivery_date", "ts_utc", "zone", "hour_local", "_r.*")


def markets_wide(long: DataFrame, keys: list[str], values: list[str], prefix: bool = True, required: list[str] | None = None) -> DataFrame:
    """da and rt side by side in one aggregate: <market>_<value>, or <value>_<market> when not prefix."""
    name = (lambda m, v: f"{m}_{v}") if prefix else (lambda m, v: f"{v}_{m}")
    aggs = [F.max(F.when(F.col("market") == m, F.col(v))).alias(name(m, v)) for m in MARKETS for v in values]
    out = long.groupBy(*keys).agg(*aggs)
    need = required if required is not None else [name(m, v) for m in MARKETS for v in values]
    return out.dropna(subset=need) if need else out


def wide_with_quantiles(long: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with y_da, y_rt and both quantile rows; incomplete rows are dropped."""
    w = markets_wide(long, keys, ["y", *QCOLS])
    return w.withColumnsRenamed({"da_y": "y_da", "rt_y": "y_rt"})


def pivot_values(df: DataFrame, keys: list[str], column: str, levels: list[str], value: str) -> DataFrame:
    """Known levels -> columns (map-side combined; no distinct scan for the levels)."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(column) == v, F.col(value))).alias(v) for v in levels])


def day_grids(df: DataFrame, keys: list[str], hour: str, values: dict[str, str]) -> DataFrame:
    """One row per key with a 24-hour array per value ({column: output}): duplicates averaged, gaps filled linearly, ends held.

    All values share two aggregates, so a wide design costs one pass over the panel.
    """
    cells = df.groupBy(*keys, F.col(hour).cast("int").alias("_h")).agg(*[F.avg(v).alias(v) for v in values])
    g = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_h", *values))).alias("_p"))

    def filled(value: str) -> Column:
        points = F.transform(F.filter("_p", lambda p: p[value].isNotNull()), lambda p: F.struct(p["_h"].alias("h"), p[value].alias("v")))

        def at(pts: Column) -> Column:
            none = F.array(F.lit(None).cast("struct<h:int,v:double>"))

            def fill(h: Column) -> Column:
                left = F.element_at(F.concat(none, F.filter(pts, lambda p: p["h"] <= h)), -1)
                right = F.get(F.filter(pts, lambda p: p["h"] >= h), F.lit(0))
                slope = F.try_divide(right["v"] - left["v"], right["h"] - left["h"])
                return F.when(left.isNull(), right["v"]).when(right.isNull() | (left["h"] == h), left["v"]).otherwise(left["v"] + slope * (h - left["h"]))

            return F.transform(F.sequence(F.lit(0), F.lit(23)), fill)

        return bind(points, at)

    return g.select(*keys, *[filled(v).alias(o) for v, o in values.items()])


def day_grid(df: DataFrame, keys: list[str], hour: str, value: str) -> DataFrame:
    """`day_grids` for one value, as column `h`."""
    return day_grids(df, keys, hour, {value: "h"})


def grid_rows(grid: DataFrame, keys: list[str], hour: str, value: str, arr: str = "h") -> DataFrame:
    return grid.select(*keys, F.posexplode(arr).alias(hour, value))


def calendar_lag(df: DataFrame, keys: list[str], day: str, days: int, values: list[str], suffix: str) -> DataFrame:
    """Values of the same keys `days` calendar days earlier, as a table to join on (keys, day)."""
    return df.select(*keys, F.date_add(day, days).alias(day), *[F.col(v).alias(f"{v}{suffix}") for v in values])


def latest_union(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Concatenate runs; on duplicate keys the later run wins.  A max_by aggregate, no ordered window."""
    tagged = [p.withColumn("_ord", F.lit(i)) for i, p in enumerate(parts)]
    u = tagged[0]
    for p in tagged[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    rest = [c for c in u.columns if c not in (*keys, "_ord")]
    g = u.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_ord").alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def time_by_node(df: DataFrame, ts: str, node: str, value: str) -> DataFrame:
    """One row per time with a map node -> value rounded to cents; a row is bounded by the node list."""
    cell = F.struct(F.col(node), F.round(F.when(~F.isnan(value), F.col(value)), 2))
    return df.groupBy(ts).agg(F.map_from_entries(F.sort_array(F.collect_list(cell))).alias("values"))


def running(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Cumulative sum and drawdown of a daily series (bounded by the calendar)."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(up)).withColumn(f"{out}_drawdown", F.col(out) - F.max(out).over(up))
