"""A linear-chain conditional random field with two labels, in numpy: hashed indicator features, exact gradients, Viterbi decoding.

Chains lie end to end.  All passes go place by place over the chains that are that long, so that one long chain costs no padding.
"""

from __future__ import annotations

import numpy as np


class Chains:
    """Feature numbers of all places, end to end: place i has features[bounds[i]:bounds[i + 1]]; chain c has places first[c]:first[c] + length[c]."""

    def __init__(self, features: list[list[int]], lengths: list[int]):
        count = np.fromiter(map(len, features), np.int64, len(features))
        self.features = np.fromiter((f for p in features for f in p), np.int64, int(count.sum()))
        self.place = np.repeat(np.arange(len(count)), count)
        self.length = np.array(lengths, np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.n = len(count)
        order = np.argsort(-self.length, kind="stable")
        self.order = order
        self.longest = int(self.length.max()) if len(lengths) else 0
        self.alive = np.searchsorted(-self.length[order], -np.arange(self.longest), side="left")     # chains longer than d

    def at(self, d: int) -> np.ndarray:
        """Places of depth d, of the chains that have it, longest chains first."""
        return self.first[self.order[:self.alive[d]]] + d


class Model:
    """Weights of label 1 (label 0 has none), transition[from, to], and the scores of the first label."""

    def __init__(self, size: int):
        self.weight, self.transition, self.start = np.zeros(size), np.zeros((2, 2)), np.zeros(2)

    def scores(self, x: Chains) -> np.ndarray:
        out = np.zeros((x.n, 2))
        out[:, 1] = np.bincount(x.place, self.weight[x.features], minlength=x.n)
        return out


def viterbi(m: Model, x: Chains) -> np.ndarray:
    """The best label of every place; ties go to label 0."""
    score, back, label = m.scores(x), np.zeros((x.n, 2), np.int8), np.zeros(x.n, np.int8)
    best = np.zeros((x.n, 2))
    for d in range(x.longest):
        at = x.at(d)
        if d == 0:
            best[at] = score[at] + m.start
        else:
            step = best[at - 1][:, :, None] + m.transition
            back[at] = step.argmax(1)
            best[at] = step.max(1) + score[at]
    for d in range(x.longest - 1, -1, -1):
        at = x.at(d)
        ends = x.length[x.order[:len(at)]] == d + 1
        last = at[ends]
        label[last] = best[last].argmax(1)
        on = at[~ends]
        label[on] = back[on + 1, label[on + 1]]
    return label


def likelihood(m: Model, x: Chains, y: np.ndarray):
    """Mean log-likelihood of the labels and its gradient (weight, transition, start), by forward and backward sums."""
    score = m.scores(x)
    a, b = np.zeros((x.n, 2)), np.zeros((x.n, 2))
    total = 0.0
    for d in range(x.longest):
        at = x.at(d)
        a[at] = score[at] + (m.start if d == 0 else np.logaddexp.reduce(a[at - 1][:, :, None] + m.transition, axis=1))
        ends = at[x.length[x.order[:len(at)]] == d + 1]
        total -= np.logaddexp.reduce(a[ends], axis=1).sum()
    for d in range(x.longest - 2, -1, -1):
        at = x.at(d)
        on = at[x.length[x.order[:len(at)]] > d + 1]
        b[on] = np.logaddexp.reduce(m.transition + (score[on + 1] + b[on + 1])[:, None, :], axis=2)
    z = np.logaddexp.reduce(a + b, axis=1, keepdims=True)
    p = np.exp(a + b - z)
    at_first = x.first[x.length > 0]
    later = np.ones(x.n, bool)
    later[at_first] = False
    later = np.flatnonzero(later)
    pair = np.exp(a[later - 1][:, :, None] + m.transition + (score[later] + b[later])[:, None, :] - z[later][:, :, None])
    total += score[np.arange(x.n), y].sum() + m.start[y[at_first]].sum() + m.transition[y[later - 1], y[later]].sum()
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[later - 1], y[later]), 1.0)
    n = max(1, len(x.length))
    weight = np.bincount(x.features, (y - p[:, 1])[x.place], minlength=len(m.weight))
    start = np.bincount(y[at_first], minlength=2) - p[at_first].sum(0)
    return total / n, (weight / n, (seen - pair.sum(0)) / n, start / n)


def train(x: Chains, y: np.ndarray, size: int, rounds: int, rate: float, penalty: float) -> Model:
    """Adam on the whole set; the penalty is half the squared weights, a chain."""
    m = Model(size)
    parts = [m.weight, m.transition, m.start]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, rounds + 1):
        _, grads = likelihood(m, x, y)
        for p, g, u, v in zip(parts, grads, first, second, strict=True):
            g = g - penalty * p
            u *= 0.9
            u += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p += rate * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return m
