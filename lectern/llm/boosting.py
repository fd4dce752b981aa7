"""Gradient-boosted regression trees for binary labels, and isotonic calibration, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BINS = 32


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """Bounds between the bins of each feature, by quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers, a row a feature."""
    out = np.zeros((x.shape[1], len(x)), np.uint8)
    for k, c in enumerate(cuts):
        if len(c):
            out[k] = np.searchsorted(c, x[:, k], "right")
    return out


class Booster:
    """Histogram trees of fixed depth on the logistic loss, with Newton leaves.

    All nodes of a level share one test, so a tree is a table that a few comparisons look up, which makes scoring cheap.
    ``prior`` gives log-odds to start from, which the trees correct as far as the data carry; without it they start from
    the rate of the labels. Rows may count several times.
    """

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, least: int = 12, ridge: float = 2.0, prior: Callable[[np.ndarray], np.ndarray] | None = None):
        self.rounds, self.depth, self.rate, self.least, self.ridge, self.prior = rounds, depth, rate, least, ridge, prior

    def fit(self, x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None, cuts: list[np.ndarray] | None = None) -> "Booster":
        self.cuts = cuts_of(x) if cuts is None else cuts
        bins = binned(x, self.cuts)
        counts = np.ones(len(y)) if counts is None else counts
        p = np.clip(np.average(y, weights=counts) if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        score = self.start(x)
        for _ in range(self.rounds if len(y) else 0):
            prob = 1 / (1 + np.exp(-score))
            tree = self._grow(bins, counts * (y - prob), counts * prob * (1 - prob))
            self.trees.append(tree)
            score += looked_up(tree, bins)
        return self

    def start(self, x: np.ndarray) -> np.ndarray:
        return self.prior(x) if self.prior else np.full(len(x), self.base)

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """The tests (feature, greatest bin that fails) of the levels, and the values of the leaves by the bits of their outcomes."""
        node, tests, width = np.zeros(bins.shape[1], np.int64), [], len(bins)
        for level in range(self.depth):
            n = 1 << level
            best, test = 1e-6, None
            for f in range(width):
                key = node * BINS + bins[f]
                cg, ch, cn = (np.bincount(key, v, n * BINS).reshape(n, BINS).cumsum(1) for v in (g, h, None))
                tg, th, tn = cg[:, -1:], ch[:, -1:], cn[:, -1:]
                gain = cg**2 / (ch + self.ridge) + (tg - cg) ** 2 / (th - ch + self.ridge) - tg**2 / (th + self.ridge)
                total = np.where(np.minimum(cn, tn - cn) < self.least, 0, gain).sum(0)
                if total.max() > best:
                    best, test = total.max(), (f, int(total.argmax()))
            if test is None:
                break
            tests.append(test)
            node = 2 * node + (bins[test[0]] > test[1])
        n = 1 << len(tests)
        return tests, np.bincount(node, g, n) / (np.bincount(node, h, n) + self.ridge) * self.rate

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the positive label."""
        bins = binned(x, self.cuts)
        return self.start(x) + sum((looked_up(t, bins) for t in self.trees), np.zeros(len(x)))


def looked_up(tree: tuple[list[tuple[int, int]], np.ndarray], bins: np.ndarray) -> np.ndarray:
    tests, values = tree
    leaf = np.zeros(bins.shape[1], np.uint8)
    for f, cut in tests:
        leaf <<= 1
        leaf |= bins[f] > cut
    return values[leaf]


class Ensemble:
    """The mean score of several boosters, each fitted on a random part of the rows; steadier than one."""

    def __init__(self, n: int = 5, part: float = 0.7, seed: int = 1, **how):
        self.n, self.part, self.seed, self.how = n, part, seed, how
        self.parts: list[Ensemble] = []

    @classmethod
    def of(cls, parts: list["Ensemble"]) -> "Ensemble":
        """The mean of ensembles, each with bins of its own."""
        out = cls(len(parts))
        out.parts = parts
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None) -> "Ensemble":
        rng = np.random.default_rng(self.seed)
        counts = np.ones(len(y)) if counts is None else counts
        takes = [rng.random(len(y)) < self.part for _ in range(self.n)]
        self.cuts = cuts_of(x)
        self.members = [Booster(**self.how).fit(x[t], y[t], counts[t], self.cuts) for t in takes]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts:
            return sum(p.score(x) for p in self.parts) / len(self.parts)
        bins = binned(x, self.cuts)
        total = sum(m.start(x) for m in self.members)
        for m in self.members:
            for tree in m.trees:
                total += looked_up(tree, bins)
        return total / self.n


class Isotonic:
    """Monotone map from scores to rates of the positive label, by pooling adjacent violators."""

    def fit(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> "Isotonic":
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # weight, sum of labels, sum of scores
        for s, label, w in zip(score[order], y[order], weight[order]):
            blocks.append([w, w * label, w * s])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
                w, a, b = blocks.pop()
                blocks[-1][0] += w
                blocks[-1][1] += a
                blocks[-1][2] += b
        self.x = np.array([b[2] / b[0] for b in blocks])
        self.y = np.array([(b[1] + 0.5 * np.average(y, weights=weight)) / (b[0] + 0.5) for b in blocks])
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
