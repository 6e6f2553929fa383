"""Trees grown from histograms against a brute-force search for every split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.operators import boosting as B


def table(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 5, n), rng.integers(-3, 20, n)]).astype(float)
    x[rng.random((n, 3)) < 0.05] = np.nan
    y = np.column_stack([np.where(np.nan_to_num(x[:, 0], nan=-1) > 6, 5.0, 1.0) + 0.3 * np.nan_to_num(x[:, 2]) + rng.normal(0, 0.2, n), np.nan_to_num(x[:, 1]) * 2.0 + rng.normal(0, 0.2, n)])
    y[rng.random(n) < 0.1, 1] = np.nan
    day, part = rng.integers(0, 40, n), rng.integers(1, 3, n)
    nul = lambda a: [[None if np.isnan(v) else float(v) for v in r] for r in a]                 # noqa: E731
    df = spark.createDataFrame([(i, int(d), int(p), r, t) for i, (d, p, r, t) in enumerate(zip(day, part, nul(x), nul(y), strict=True))], "id long, day int, part int, x array<double>, y array<double>")
    return df.repartition(5), x, y, day, part


FITS = [B.Fit(("a",), 0, 0, 30, 30, 40), B.Fit(("b",), 1, 5, 40, 30, 40), B.Fit(("c",), 0, 0, 20, 20, 40, only=2), B.Fit(("none",), 0, 90, 99, 30, 40)]


def brute_tree(x, g, h, depth, least):
    """Heap of (feature, cut) and leaf values, best gain first, then the smaller feature, then the smaller cut."""
    tree, value = {}, {0: g.sum() / h.sum()}

    def split(at, node, d):
        if d == depth:
            return
        best = None
        for f in range(x.shape[1]):
            for c in range(x[:, f].max() + 1):
                left = at & (x[:, f] <= c)
                right = at & ~left
                if left.sum() < least or right.sum() < least:
                    continue
                gain = round(g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[at].sum() ** 2 / h[at].sum(), 9)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, f, c, left, right)
        if best:
            _, f, c, left, right = best
            tree[node] = (f, c)
            value[2 * node + 1], value[2 * node + 2] = g[left].sum() / h[left].sum(), g[right].sum() / h[right].sum()
            split(left, 2 * node + 1, d + 1)
            split(right, 2 * node + 2, d + 1)

    split(np.ones(len(x), bool), 0, 0)
    return tree, value


@pytest.mark.parametrize("loss", ["l2", "logistic"])
def test_trees_equal_a_search_of_all_splits(spark, monkeypatch, loss):
    monkeypatch.setattr(B, "RESTAGE", 2)                # three trees: scores are brought up to date in between
    monkeypatch.setattr(B, "TASK_BYTES", 1)             # and every fit is a share of its own
    df, x, y, day, part = table(spark)
    if loss == "logistic":
        y = np.where(np.isnan(y), np.nan, (y > 4).astype(float))
        df = df.withColumn("y", F.transform("y", lambda v: (v > 4).cast("double")))
    o = B.Options(loss, trees=3, depth=3, rate=0.5, min_rows=8, bins=32, rows=1.0, features=1.0)
    forest = B.boost(df, FITS, 3, 2, o)
    got = {(r["id"], r["fit"]): r["mean"] for r in B.predict(df, forest, o).collect()}
    bins = B.binned(x, forest.edges)
    for k, fit in enumerate(FITS[:3]):
        at = (day >= fit.first) & (day < fit.last) & ~np.isnan(y[:, fit.target]) & ((part == fit.only) if fit.only else True)
        target = y[at, fit.target]
        start = target.mean() if loss == "l2" else np.log(target.mean() / (1 - target.mean()))
        score, every = np.full(at.sum(), start), np.full(len(x), start)
        for t in range(3):
            p = 1 / (1 + np.exp(-score))
            g, h = (target - score, np.ones(len(score))) if loss == "l2" else (target - p, np.maximum(p * (1 - p), 1e-12))
            tree, value = brute_tree(bins[at].astype(int), g, h, 3, 8)
            grown = {n: (int(forest.feature[t][k, n]), int(forest.cut[t][k, n])) for n in range(15) if forest.feature[t][k, n] >= 0}
            assert grown == tree, (fit, t)
            leaf = B.descend(bins, forest.feature[t][k], forest.cut[t][k], 3)
            step = np.array([value[n] for n in leaf])
            every += 0.5 * step
            score += 0.5 * step[at]
        test = np.flatnonzero((day >= fit.test_first) & (day < fit.test_last) & ((part == fit.only) if fit.only else True))
        want = every if loss == "l2" else 1 / (1 + np.exp(-every))
        assert {i for i, f in got if f == k} == set(test) and all(got[i, k] == pytest.approx(want[i], abs=1e-9) for i in test)


def test_absolute_loss_uses_medians_and_draws_repeat(spark):
    df, x, y, day, _ = table(spark, 300, 5)
    o = B.Options("l1", trees=12, depth=3, rate=0.5, min_rows=5, bins=32, seed=4)
    a, b = (B.boost(df, FITS[:2], 3, 2, o) for _ in range(2))
    assert all(np.array_equal(p, q) for p, q in zip(a.value, b.value, strict=True))
    pred = {r["id"]: r["mean"] for r in B.predict(df, a, o).where("fit = 0").collect()}
    test = (day >= 30) & (day < 40)
    err = np.array([abs(pred[i] - y[i, 0]) for i in np.flatnonzero(test)])
    assert err.mean() < 0.5 * np.abs(y[test, 0] - np.median(y[day < 30, 0])).mean()
    assert a.start[0] == pytest.approx(np.median(y[day < 30, 0]), abs=0.1)


def test_a_level_is_one_aggregate_of_all_fits(spark):
    df, *_ = table(spark)
    run = B.Booster(df, FITS, 3, 2, B.Options(trees=1, depth=2, min_rows=5, rows=1.0, features=1.0))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("level", "level")
    rows = run.level(0, 0, np.full((4, 7), -1, np.int16), np.zeros((4, 7), np.uint8))
    jobs = tracker.getJobIdsForGroup("level")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["fit"] for r in rows} == {0, 1, 2} and len(jobs) <= 2          # one exchange


def test_rare_values_are_cuts_of_their_own(spark):
    """A value too rare for any quantile is still a cut when the bins suffice for all values."""
    values = [(0.0, 1000, 5.0), (1.0, 4, 9.0), (2.0, 4, 1.0), (3.0, 1000, 5.0)]
    rows = [(i, 0, 0, [v, None if v == 1.0 else v], [y]) for i, (v, y) in enumerate((v, y) for v, n, y in values for _ in range(n))]
    df = spark.createDataFrame(rows, "id bigint, day int, part int, x array<double>, y array<double>")
    forest = B.boost(df, [B.Fit(("f",), 0, 0, 1, 0, 1)], 2, 1, B.Options("l2", trees=1, depth=1, rate=1.0, min_rows=1, bins=16, rows=1.0, features=1.0))
    assert [e.tolist() for e in forest.edges] == [[0.0, 1.0, 2.0], [0.0, 2.0]]
