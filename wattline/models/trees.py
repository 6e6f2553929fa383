"""Boosted-tree price models: one pooled fit per fold, market and component, all grown together (`operators.boosting`)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.boosting import Fit, Options, boost, predict
from wattline.plans.folds import Fold
from wattline.plans.panel import FEATURE_SETS
from wattline.session import cut_lineage
from wattline.settings import COMPONENTS, ENERGY_ZONE, LOCATIONS, MARKETS

TARGETS = [(m, c) for m in MARKETS for c in COMPONENTS]
MISSING = -9999.0       # trees split a value below every real one away from the rest


def assemble_features(df: DataFrame, features: list[str], zones: list[str] | None = None, out: str = "features") -> DataFrame:
    """Vector of the features; NULL becomes a sentinel, the zone a small integer code."""
    cols = {f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features}
    if zones:
        code = F.array_position(F.array(*[F.lit(z) for z in zones]), F.col("zone")).cast("double")
        cols["_x_zone"] = code
    full = df.withColumns(cols)
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(full).drop(*cols)


class BoostedModel:
    def __init__(self, objective: str = "l1", n_trees: int = 500, window_days: int | None = 728, feature_set: str = "v1", depth: int = 6,
                 learning_rate: float = 0.05, min_rows: int = 200, zones: list[str] = LOCATIONS, energy_zone: str = ENERGY_ZONE, seed: int = 0):
        self.name = f"gbm_{objective}" + ("" if feature_set == "v1" else f"_{feature_set}")
        self.objective, self.n_trees, self.window_days, self.feature_set = objective, n_trees, window_days, feature_set
        self.depth, self.learning_rate, self.min_rows, self.seed = depth, learning_rate, min_rows, seed
        self.zones, self.energy_zone, self.features = zones, energy_zone, FEATURE_SETS[feature_set]

    def config(self) -> dict:
        return {"model": "histogram trees", "objective": self.objective, "trees": self.n_trees, "train_window_days": self.window_days or "all",
                "depth": self.depth, "learning_rate": self.learning_rate, "min_rows": self.min_rows, "feature_set": self.feature_set}

    def options(self) -> Options:
        return Options(self.objective, self.n_trees, self.depth, self.learning_rate, self.min_rows, bins=127, rows=0.8, features=0.8, seed=self.seed)

    def fits(self, folds: list[Fold]) -> list[Fit]:
        """A fit for each fold, market and component; the energy part is the same everywhere and learned from one zone."""
        number = lambda d: (d - date(1970, 1, 1)).days                                   # noqa: E731
        out = []
        for f in folds:
            start = f.train_start if self.window_days is None else max(f.train_start, f.train_end - timedelta(days=self.window_days))
            out += [Fit((f.name, m, c), i, number(start), number(f.train_end), number(f.test_start), number(f.test_end), self.zones.index(self.energy_zone) + 1 if c == "energy" else None)
                    for i, (m, c) in enumerate(TARGETS)]
        return out

    def fit_predict(self, panel: DataFrame, folds: list[Fold]) -> DataFrame:
        """Every level of a tree is one job for all folds, markets and components."""
        code = F.array_position(F.array(*[F.lit(z) for z in self.zones]), F.col("zone")).cast("int")
        x = F.array(*[F.col(c).cast("double") for c in self.features], code.cast("double"))
        rows = panel.select(F.xxhash64("ts_utc", "zone").alias("id"), F.unix_date("delivery_date").alias("day"), code.alias("part"), x.alias("x"),
                            F.array(*[F.col(f"{m}_{c}").cast("double") for m, c in TARGETS]).alias("y"), "delivery_date", "ts_utc", "zone", "hour_local")
        rows = cut_lineage(rows.where("part > 0"))
        fits, options = self.fits(folds), self.options()
        forest = boost(rows.select("id", "day", "part", "x", "y"), fits, len(self.features) + 1, len(TARGETS), options)
        made = predict(rows, forest, options)
        keys = ["delivery_date", "ts_utc", "zone", "hour_local"]
        names = F.array(*[F.struct(F.lit(f.name[0]).alias("fold"), F.lit(f.name[1]).alias("market"), F.lit(f.name[2]).alias("component")) for f in fits])
        got = made.join(rows.select("id", *keys), "id").select(*keys, F.get(names, F.col("fit")).alias("_f"), "mean").select("_f.*", *keys, "mean")
        energy = got.where("component = 'energy'").select("fold", "market", "ts_utc", F.col("mean").alias("_energy"))
        days = [(F.col("delivery_date") >= F.lit(f.test_start)) & (F.col("delivery_date") < F.lit(f.test_end)) for f in folds]
        spans = F.filter(F.array(*[F.when(d, F.lit(f.name)) for d, f in zip(days, folds, strict=True)]), lambda v: v.isNotNull())
        every = rows.select(*keys, F.explode(spans).alias("fold")).withColumn("market", F.explode(F.array(*map(F.lit, MARKETS))))
        shared = every.join(energy, ["fold", "market", "ts_utc"], "left").withColumn("component", F.lit("energy")).withColumnRenamed("_energy", "mean")
        columns = ["fold", *keys, "market", "component", "mean"]
        return got.where("component <> 'energy'").select(columns).unionByName(shared.select(columns))
