"""Shared inputs of the check queries, in Spark and in SQL.

The test tables are turned into market-like series once, here: `events` is an irregular interval series (entity =
event_type), and orders with their lines are a daily book of two prices per order priority.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.plans.folds import Fold, monthly_folds
from wattline.session import cut_lineage, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHIFT_DAYS = 300                # moves the January events over the autumn clock change
FOLD_START, FOLD_END, ORIGIN = date(1997, 1, 1), date(2001, 12, 1), date(1995, 1, 1)     # 1995-96 is burn-in; folds run to the last month of the data


def check(name: str, sql: str | None = None):
    """Register a query; `sql` is the same question in SQL."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


class Tables:
    """The test tables; stored stamps carry no zone and are UTC."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._book = spark, root, None

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})

    def shifted(self) -> DataFrame:
        """events as an end-stamped series: ts_utc, zone, value, user_id."""
        ts = F.col("ts") + F.expr(f"INTERVAL {SHIFT_DAYS} DAY")
        return self.events.select(ts.alias("ts_utc"), F.col("event_type").alias("zone"), "value", "user_id", "event_id")

    def book(self) -> DataFrame:
        """(d, zone, da, rt): mean and quantity-weighted mean line price per ship day and order priority, in thousands.

        Sums are exact decimals, so both engines agree to the last digit.  The book is days x priorities, so it is staged once for all its uses in a query:
        otherwise each of them would join lineitem with orders again.
        """
        if self._book is None:
            self._book = cut_lineage(self._joined_book())
        return self._book

    def _joined_book(self) -> DataFrame:
        l = self.lineitem.select("l_orderkey", "l_shipdate", F.col("l_extendedprice").cast("decimal(18,2)").alias("p"),
                                 F.col("l_quantity").cast("decimal(18,2)").alias("q"))
        j = l.join(self.orders.select("o_orderkey", "o_orderpriority"), l.l_orderkey == F.col("o_orderkey"))
        g = j.groupBy(F.to_date("l_shipdate").alias("d"), F.col("o_orderpriority").alias("zone")).agg(
            F.sum("p").cast("double").alias("_p"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("p") * F.col("q")).cast("double").alias("_pq"),
            F.sum("q").cast("double").alias("_q"))
        return g.select("d", "zone", half_up(F.col("_p") / F.col("_n") / 1000).alias("da"), half_up(F.col("_pq") / F.col("_q") / 1000).alias("rt"))

    def lagged_book(self) -> DataFrame:
        """Book with da of 1, 2 and 7 days and rt of 2 days earlier, by calendar date."""
        lags = ((1, "da"), (7, "da"), (2, "rt"), (2, "da"))
        laid = self.book().withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2, 7))))).withColumn("d", F.expr("date_add(d, k)"))
        at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))                       # noqa: E731
        one = laid.groupBy("d", "zone").agg(F.min("k").alias("k"), at(0, "da").alias("da"), at(0, "rt").alias("rt"), *[at(k, c).alias(f"{c}_l{k}") for k, c in lags])
        return one.where("k = 0").drop("k")

    def predictions(self) -> DataFrame:
        """Long prediction rows of two naive members (trial m1: a day earlier, m7: a week earlier, m2: two days) for da and rt."""
        b = self.lagged_book()
        rows = F.array(*[F.struct(F.lit(m).alias("market"), F.lit(t).alias("trial"), F.coalesce(*[F.col(c) for c in cols]).alias("mean"), F.col(m).alias("y"))
                         for m in ("da", "rt") for t, cols in (("m1", ("da_l1", "da_l7")), ("m2", ("rt_l2", "da_l1", "da_l7")), ("m7", ("da_l7", "da_l1")))])
        p = b.select(F.col("d").alias("delivery_date"), "zone", F.explode(rows).alias("_r")).select("delivery_date", "zone", "_r.*")
        return p.select("delivery_date", F.col("delivery_date").cast("timestamp").alias("ts_utc"), "zone", F.lit(0).alias("hour_local"), "market",
                        F.lit("total").alias("component"), "trial", "mean", "y", F.lit(True).alias("scored"), F.lit(None).cast("double").alias("ref_mean"))

    def folds(self) -> list[Fold]:
        return monthly_folds(FOLD_START, FOLD_END, origin=ORIGIN)


def parents(t: Tables, names: tuple = ("m1", "m7", "m2")) -> dict[str, DataFrame]:
    p = t.predictions()
    return {n: p.filter(F.col("trial") == n).drop("trial") for n in names}


def half_up(x: Column, scale: int = 10_000) -> Column:
    """Round by floor(x * scale + 0.5): the same double arithmetic in both engines, ties included."""
    return F.floor(x * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, times without zone."""
    cols = {c: F.round(F.col(c), digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"}
    cols |= {c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"}
    return df.withColumns(cols) if cols else df


# ------------------------------------------------------------------------------------------ SQL building blocks

SHIFTED_SQL = f"""ev AS (SELECT ts + INTERVAL {SHIFT_DAYS} DAY AS ts_utc, event_type AS zone, value, user_id, event_id FROM events)"""
LOCAL = "timezone('America/New_York', timezone('UTC', {0}))"
BOOK_SQL = """book AS MATERIALIZED (
  SELECT CAST(l_shipdate AS DATE) AS d, o_orderpriority AS zone,
         floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000 * 10000 + 0.5) / 10000 AS da,
         floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)
               / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 1000 * 10000 + 0.5) / 10000 AS rt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
LAGGED_SQL = BOOK_SQL + """,
lagged AS MATERIALIZED (
  SELECT b.d, b.zone, b.da, b.rt, a1.da AS da_l1, a7.da AS da_l7, r2.rt AS rt_l2, a2.da AS da_l2
  FROM book b LEFT JOIN book a1 ON a1.zone = b.zone AND a1.d = b.d - 1
  LEFT JOIN book a7 ON a7.zone = b.zone AND a7.d = b.d - 7
  LEFT JOIN book r2 ON r2.zone = b.zone AND r2.d = b.d - 2
  LEFT JOIN book a2 ON a2.zone = b.zone AND a2.d = b.d - 2)"""
PRED_SQL = LAGGED_SQL + """,
pred AS MATERIALIZED (
  SELECT d, zone, 'da' AS market, 'm1' AS trial, coalesce(da_l1, da_l7) AS mean, da AS y FROM lagged
  UNION ALL SELECT d, zone, 'da', 'm2', coalesce(rt_l2, da_l1, da_l7), da FROM lagged
  UNION ALL SELECT d, zone, 'da', 'm7', coalesce(da_l7, da_l1), da FROM lagged
  UNION ALL SELECT d, zone, 'rt', 'm1', coalesce(da_l1, da_l7), rt FROM lagged
  UNION ALL SELECT d, zone, 'rt', 'm2', coalesce(rt_l2, da_l1, da_l7), rt FROM lagged
  UNION ALL SELECT d, zone, 'rt', 'm7', coalesce(da_l7, da_l1), rt FROM lagged)"""
FOLDS_SQL = f"""folds AS (
  SELECT strftime(m, '%Y-%m') AS fold, DATE '{ORIGIN}' AS train_start, CAST(m - INTERVAL 7 DAY AS DATE) AS train_end,
         CAST(m AS DATE) AS test_start, CAST(m + INTERVAL 1 MONTH AS DATE) AS test_end
  FROM (SELECT unnest(generate_series(TIMESTAMP '{FOLD_START}', TIMESTAMP '{FOLD_END}' - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS m))"""
