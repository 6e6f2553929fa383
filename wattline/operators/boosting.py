"""Gradient-boosted trees of many fits at once, grown level by level from histograms.

All fits (folds, markets, components ...) share one table of binned rows.  For each level of a tree one job adds up gradients by (fit, node, feature, bin)
in the tasks, Spark sums them, and a window over the at most `bins` bins of a feature finds each node's best split; the driver only sees the
splits, one row a node.  So a tree of depth D costs D jobs, whatever the number of fits.  Scores of rows are carried in the staged table and brought up to
date every `RESTAGE` trees; in between, tasks add the few newer trees.

Losses: l2, l1 (leaves are medians of the residuals, from a mergeable sketch), logistic (Newton leaves).  NULL and NaN features are bin 0, left of every
real value.  Rows and features of a tree are drawn by hashes, so a lost task draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.session import cut_lineage

RESTAGE = 10
TASK_BYTES = 64 << 20               # histograms that a task holds; with more fits the table is read once for each share of them


@dataclass(frozen=True)
class Fit:
    """Rows with first <= day < last (days since 1970), a value of target number `target` and, if given, the group `only`, are learned from; rows of the
    test days are predicted."""

    name: tuple
    target: int
    first: int
    last: int
    test_first: int
    test_last: int
    only: int | None = None


@dataclass(frozen=True)
class Options:
    loss: str = "l2"
    trees: int = 500
    depth: int = 6
    rate: float = 0.05
    min_rows: int = 200
    bins: int = 64
    rows: float = 0.8
    features: float = 0.8
    seed: int = 0


@dataclass
class Forest:
    """Trees of each fit as heaps: feature (-1: leaf) and cut (left: bin <= cut) [fit, tree, node], value [fit, tree, node]; start [fit]; edges of the bins."""

    fits: list[Fit]
    edges: list[np.ndarray]
    start: np.ndarray
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: 0 where missing, k where edges[k - 2] < value <= edges[k - 1]."""
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        v = x[:, j]
        out[:, j] = np.where(np.isnan(v), 0, np.searchsorted(e, v, side="left") + 1)
    return out


def descend(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Heap place of the leaf that each row reaches after at most `depth` steps."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
    return node


def _drawn(ids: np.ndarray, tree: int, o: Options) -> np.ndarray:
    if o.rows >= 1:
        return np.ones(len(ids), bool)
    z = (ids.view(np.uint64) ^ np.uint64((o.seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64))
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
    return (z >> np.uint64(11)).astype(float) / 2.0**53 < o.rows


def _features(tree: int, n: int, o: Options) -> np.ndarray:
    keep = max(1, round(n * o.features))
    return np.sort(np.random.default_rng([o.seed, tree]).permutation(n)[:keep])


class _Rows:
    """A batch of the staged table as arrays."""

    def __init__(self, b: pa.RecordBatch, width: int, targets: int, fits: int):
        n = len(b)
        flat = lambda name, kind: np.frombuffer(b"".join(b.column(name).to_pylist()), kind)                # noqa: E731
        self.id, self.day, self.group = b.column("id").to_numpy(), b.column("day").to_numpy(), b.column("part").to_numpy()
        self.x, self.y = flat("x", np.uint8).reshape(n, width), flat("y", np.float64).reshape(n, targets)
        self.score = flat("score", np.float64).reshape(n, fits).copy() if "score" in b.schema.names else np.zeros((n, fits))

    def of(self, fit: Fit) -> np.ndarray:
        ok = (self.day >= fit.first) & (self.day < fit.last) & ~np.isnan(self.y[:, fit.target])
        return np.flatnonzero(ok if fit.only is None else ok & (self.group == fit.only))


def _few_values(width: int, most: int):
    """The task that lists the values of each feature, or says that it saw more than `most`."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.zeros(0)] * width
        for b in it:
            x = np.array([[np.nan if v is None else v for v in r] for r in b.column("x").to_pylist()], float).reshape(len(b), -1)
            for j in range(width):
                if seen[j] is not None:
                    v = np.union1d(seen[j], x[~np.isnan(x[:, j]), j])
                    seen[j] = v if len(v) <= most else None
        size = [1 if v is None else len(v) for v in seen]
        v = np.concatenate([np.zeros(1) if v is None else v for v in seen])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width, dtype=np.int32), size)), pa.array(v), pa.array(np.repeat([v is None for v in seen], size))], ["feature", "v", "many"])

    return run


class Booster:
    """One run: rows(id bigint, day int, part int, x array<double>, y array<double>)."""

    def __init__(self, rows: DataFrame, fits: list[Fit], width: int, targets: int, options: Options):
        self.fits, self.width, self.targets, self.o = fits, width, targets, options
        self.forest = Forest(fits, self._edges(rows, width), np.zeros(len(fits)))
        edges = self.forest.edges

        def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x, y = (np.array([[np.nan if v is None else v for v in r] for r in b.column(c).to_pylist()], float).reshape(len(b), -1) for c in ("x", "y"))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("day"), b.column("part"), pa.array([r.tobytes() for r in binned(x, edges)], pa.binary()),
                                                  pa.array([r.tobytes() for r in y], pa.binary()), pa.array([np.zeros(len(fits)).tobytes()] * len(b), pa.binary())], ["id", "day", "part", "x", "y", "score"])

        self.ddl = "id bigint, day int, part int, x binary, y binary, score binary"
        self.table = cut_lineage(rows.mapInArrow(pack, self.ddl))
        self.fresh = 0                                       # trees that the staged scores have

    def __getstate__(self) -> dict:
        """What tasks get: the table stays behind, and so do trees that the staged scores already have."""
        old = [None] * self.fresh
        f = self.forest
        return self.__dict__ | {"table": None, "forest": replace(f, feature=old + f.feature[self.fresh:], cut=old + f.cut[self.fresh:], value=old + f.value[self.fresh:])}

    def _edges(self, rows: DataFrame, width: int) -> list[np.ndarray]:
        """Bin edges of each feature: every value but the largest if the bins suffice for them, so that a rare value stays a cut of its own; else
        quantiles of its values, all features in one aggregate."""
        probs = [i / (self.o.bins - 1) for i in range(1, self.o.bins - 1)]
        value = lambda j: F.nanvl(F.get("x", F.lit(j)), F.lit(None).cast("double"))                        # noqa: E731
        found = rows.agg(*[F.approx_percentile(value(j), probs, 10_000).alias(f"q{j}") for j in range(width)]).first()
        few = {r["feature"]: r["v"] for r in rows.select("x").mapInArrow(_few_values(width, self.o.bins - 1), "feature int, v double, many boolean")
               .groupBy("feature").agg(F.bool_or("many").alias("many"), F.sort_array(F.collect_set("v")).alias("v")).where(~F.col("many") & (F.size("v") < self.o.bins)).collect()}
        return [np.array(few[j], float)[:-1] if few.get(j) else np.unique(np.array(q, float)) if q is not None else np.zeros(0) for j, q in enumerate(found)]

    # -- tasks

    def _scores(self, r: _Rows, k: int, at: np.ndarray, upto: int) -> np.ndarray:
        s = r.score[at, k] + (self.forest.start[k] if self.fresh == 0 else 0.0)
        for t in range(self.fresh, upto):
            s = s + self.o.rate * self.forest.value[t][k][descend(r.x[at], self.forest.feature[t][k], self.forest.cut[t][k], self.o.depth)]
        return s

    def _gradient(self, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.o.loss == "logistic":
            p = 1 / (1 + np.exp(-s))
            return y - p, np.maximum(p * (1 - p), 1e-12)
        return (np.sign(y - s) if self.o.loss == "l1" else y - s), np.ones(len(y))

    def _histograms(self, share: range, tree: int, level: int, feature: np.ndarray, cut: np.ndarray):
        own, o, base, bins = _features(tree, self.width, self.o), self.o, 2**level - 1, self.o.bins

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(share), 2**level, len(own), bins, 3))
            for b in it:
                r = _Rows(b, self.width, self.targets, len(self.fits))
                drawn = _drawn(r.id, tree, o)
                for i, k in enumerate(share):
                    at = r.of(self.fits[k])
                    at = at[drawn[at]]
                    if not len(at):
                        continue
                    node = descend(r.x[at], feature[k], cut[k], level) - base
                    at, node = at[node >= 0], node[node >= 0]                   # others rest in a leaf above this level
                    g, h = self._gradient(r.y[at, self.fits[k].target], self._scores(r, k, at, tree))
                    for j, f in enumerate(own):
                        cell = node * bins + r.x[at, f]
                        for c, w in enumerate((g, h, None)):
                            total[i, :, j, :, c] += np.bincount(cell, w, 2**level * bins).reshape(2**level, bins)
            i, node, j, cell = np.nonzero(total[..., 2])
            v = total[i, node, j, cell]
            k = np.array(share, np.int32)[i] if len(i) else np.zeros(0, np.int32)
            for a in range(0, len(i), 65536):
                z = slice(a, a + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(k[z]), pa.array((node[z] + base).astype(np.int32)), pa.array(own[j[z]].astype(np.int32)), pa.array(cell[z].astype(np.int32)), *(pa.array(v[z, c]) for c in range(3))],
                                                 ["fit", "node", "feature", "bin", "g", "h", "n"])

        return run

    def _shares(self, cells: int) -> list[range]:
        step = max(1, TASK_BYTES // (24 * cells))
        return [range(a, min(a + step, len(self.fits))) for a in range(0, len(self.fits), step)]

    def level(self, tree: int, level: int, feature: np.ndarray, cut: np.ndarray) -> list:
        """Best split and totals of each node of the level: one job."""
        ddl = "fit int, node int, feature int, bin int, g double, h double, n double"
        parts = None
        for share in self._shares(2**level * self.width * self.o.bins):
            p = self.table.mapInArrow(self._histograms(share, tree, level, feature, cut), ddl)
            parts = p if parts is None else parts.unionByName(p)
        # tasks have folded their rows into cells already, so one exchange by node serves the sums, the windows and the choice
        sums = parts.repartition("fit", "node").groupBy("fit", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])
        whole = Window.partitionBy("fit", "node", "feature")
        left = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        laid = sums.select("fit", "node", "feature", "bin", *[F.sum(c).over(left).alias(f"l{c}") for c in "ghn"], *[F.sum(c).over(whole).alias(f"t{c}") for c in "ghn"])
        rg, rh = F.col("tg") - F.col("lg"), F.col("th") - F.col("lh")
        gain = F.col("lg") * F.col("lg") / F.col("lh") + rg * rg / rh - F.col("tg") * F.col("tg") / F.col("th")
        allowed = (F.col("ln") >= self.o.min_rows) & (F.col("tn") - F.col("ln") >= self.o.min_rows) & (rh > 0)
        split = F.when(allowed & (gain > 1e-9), F.struct(F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "lg", "lh"))
        return laid.groupBy("fit", "node").agg(F.max(split).alias("best"), F.max(F.struct("tn", "tg", "th")).alias("all")).collect()

    def _leaf_rows(self, tree: int, feature: np.ndarray | None, cut: np.ndarray | None):
        """(fit, node, r): residuals by leaf, or the targets themselves before the first tree."""
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                r = _Rows(b, self.width, self.targets, len(self.fits))
                drawn = _drawn(r.id, tree, self.o) if feature is not None else np.ones(len(b), bool)
                for k, fit in enumerate(self.fits):
                    at = r.of(fit)
                    at = at[drawn[at]]
                    if len(at):
                        node = np.zeros(len(at), np.int64) if feature is None else descend(r.x[at], feature[k], cut[k], self.o.depth)
                        rest = r.y[at, fit.target] - (0.0 if feature is None else self._scores(r, k, at, tree))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(node.astype(np.int32)), pa.array(rest)], ["fit", "node", "r"])

        return self.table.mapInArrow(run, "fit int, node int, r double").groupBy("fit", "node")

    def _restage(self) -> None:
        upto = len(self.forest.value)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                r = _Rows(b, self.width, self.targets, len(self.fits))
                for k, fit in enumerate(self.fits):
                    at = r.of(fit)
                    r.score[at, k] = self._scores(r, k, at, upto)
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([s.tobytes() for s in r.score], pa.binary())], b.schema.names)

        self.table = cut_lineage(self.table.mapInArrow(run, self.ddl))
        self.fresh = upto

    # -- the driver's loop

    def grow(self) -> Forest:
        o, f, size = self.o, self.forest, 2 ** (self.o.depth + 1) - 1
        middle = F.approx_percentile("r", 0.5, 10_000) if o.loss == "l1" else F.avg("r")
        for row in self._leaf_rows(0, None, None).agg(middle.alias("v")).collect():
            f.start[row["fit"]] = np.log(max(row["v"], 1e-6) / max(1 - row["v"], 1e-6)) if o.loss == "logistic" else row["v"]
        for tree in range(o.trees):
            feature, cut, value = np.full((len(self.fits), size), -1, np.int16), np.zeros((len(self.fits), size), np.uint8), np.zeros((len(self.fits), size))
            for level in range(o.depth):
                grew = False
                for row in self.level(tree, level, feature, cut):
                    k, node, best, (_, tg, th) = row["fit"], row["node"], row["best"], row["all"]
                    if level == 0:
                        value[k, 0] = tg / th
                    if best is not None:
                        grew = True
                        feature[k, node], cut[k, node] = -best["f"], -best["b"]
                        value[k, 2 * node + 1], value[k, 2 * node + 2] = best["lg"] / best["lh"], (tg - best["lg"]) / (th - best["lh"])
                if not grew:
                    break
            if o.loss == "l1":
                for row in self._leaf_rows(tree, feature, cut).agg(F.approx_percentile("r", 0.5, 10_000).alias("v")).collect():
                    value[row["fit"], row["node"]] = row["v"]
            f.feature.append(feature)
            f.cut.append(cut)
            f.value.append(value)
            if len(f.value) - self.fresh >= RESTAGE and tree + 1 < o.trees:
                self._restage()
        return f


def predict(rows: DataFrame, forest: Forest, options: Options) -> DataFrame:
    """(id, fit, mean): predictions of every fit for the rows of its test days; logistic fits give probabilities."""
    def of(share: range):
        fits, start = forest.fits, forest.start
        trees = [(f[share.start:share.stop], c[share.start:share.stop], v[share.start:share.stop]) for f, c, v in zip(forest.feature, forest.cut, forest.value, strict=True)]
        return _predictor([(k, fits[k], start[k]) for k in share], trees, forest.edges, options)

    step = max(1, TASK_BYTES // max(1, 11 * len(forest.value) * 2 ** (options.depth + 1)))
    slim, out = rows.select("id", "day", "part", "x"), None
    for a in range(0, len(forest.fits), step):
        p = slim.mapInArrow(of(range(a, min(a + step, len(forest.fits)))), "id bigint, fit int, mean double")
        out = p if out is None else out.unionByName(p)
    return out


def _predictor(fits: list[tuple], trees: list[tuple], edges: list[np.ndarray], options: Options):
    """The task that predicts some of the fits: (number, fit, start), and each tree's arrays of just these."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw = np.array([[np.nan if v is None else v for v in r] for r in b.column("x").to_pylist()], float).reshape(len(b), len(edges))
            x, day, group, ids = binned(raw, edges), b.column("day").to_numpy(), b.column("part").to_numpy(), b.column("id").to_numpy()
            for i, (k, fit, start) in enumerate(fits):
                at = (day >= fit.test_first) & (day < fit.test_last)
                at = np.flatnonzero(at if fit.only is None else at & (group == fit.only))
                if not len(at):
                    continue
                s = np.full(len(at), start)
                for feature, cut, value in trees:
                    s += options.rate * value[i][descend(x[at], feature[i], cut[i], options.depth)]
                s = 1 / (1 + np.exp(-s)) if options.loss == "logistic" else s
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), k, np.int32)), pa.array(s)], ["id", "fit", "mean"])

    return run


def boost(rows: DataFrame, fits: list[Fit], width: int, targets: int, options: Options) -> Forest:
    return Booster(rows, fits, width, targets, options).grow()
