"""As-of joins: for each left row, the latest right row of the same key that was available at or before its time.

Two recipes.  `asof_few` for a right side with a small, fixed number of versions per key (forecast vintages): an
equi-join and `max_by`.  `asof_long` for a long right side: both sides are tagged, merged in time order inside time
chunks, and the value before the chunk is carried in from per-chunk summaries.  Matching is inclusive (`<=`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators.ordered import DAY, chunk_of


def asof_few(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str],
             tie: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Right side: few versions per `on` key.  Left rows must be unique; carry the needed columns in `left`."""
    order = F.struct(right_time, *(tie or []))
    slim = right.select(*on, right_time, *[c for c in [*values, *(tie or [])] if c not in on and c != right_time])
    joined = left.join(slim, on).filter(F.col(right_time) <= F.col(left_time))
    best = joined.groupBy(*left.columns).agg(F.max_by(F.struct(right_time, *values), order).alias("_hit"))
    out = best.select(*left.columns, F.col(f"_hit.{right_time}").alias(right_time),
                      *[F.col("_hit")[v].alias(v) for v in values if v != right_time])
    return out if how == "inner" else left.join(out, left.columns, "left")


def asof_long(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str],
              tie: list[str] | None = None, how: str = "inner", chunk: int = DAY) -> DataFrame:
    """Tag-and-merge as-of join.  Adds `right_time` and `values` of the matched row; `how='inner'` drops rows without one.

    Rows are shuffled once on (by, chunk); a hot key is spread over its chunks.
    """
    keep = [right_time, *values]
    order = [right_time, *(tie or [])]
    facts = right.select(*by, F.struct(*keep).alias("_hit"), F.struct(*order).alias("_ord"), F.col(right_time).alias("_t"))
    facts = facts.withColumn("_chunk", chunk_of(F.col("_t"), chunk))
    asks = left.select(*by, F.struct(*left.columns).alias("_row"), F.col(left_time).alias("_t"))
    asks = asks.withColumn("_chunk", chunk_of(F.col("_t"), chunk))

    tagged = facts.withColumn("_side", F.lit(0)).drop("_ord").unionByName(
        asks.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    if tie:
        tagged = facts.withColumn("_side", F.lit(0)).unionByName(asks.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    sort = ["_t", "_side", *(["_ord"] if tie else [])]
    inside = Window.partitionBy(*by, "_chunk").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    matched = tagged.withColumn("_near", F.last("_hit", ignorenulls=True).over(inside)).filter(F.col("_side") == 1)

    last_in = facts.groupBy(*by, "_chunk").agg(F.max_by("_hit", "_ord").alias("_hit"))
    marks = last_in.unionByName(asks.select(*by, "_chunk").distinct(), allowMissingColumns=True)
    marks = marks.groupBy(*by, "_chunk").agg(F.first("_hit", ignorenulls=True).alias("_hit"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (marks.withColumn("_carry", F.last("_hit", ignorenulls=True).over(before))
               .select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_chunk").alias("_c"), "_carry")
               .filter(F.col("_carry").isNotNull()))
    on = F.col("_chunk") == F.col("_c")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    found = matched.join(carried, on, "left").withColumn("_best", F.coalesce("_near", "_carry"))
    if how == "inner":
        found = found.filter(F.col("_best").isNotNull())
    return found.select(*[F.col("_row")[c].alias(c) for c in left.columns], *[F.col("_best")[c].alias(c) for c in keep])
