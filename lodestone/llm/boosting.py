"""Gradient-boosted trees for a yes/no label, with monotonic constraints, held as flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees' nodes in one row of arrays; ``feature`` is -1 at leaves, whose children are themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row: every step moves all rows one level down all trees at once."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            at = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _value(g, h, l2, low, high):
    return np.clip(-g / (h + l2), low, high)


def _loss(g, h, l2, w):
    return g * w + 0.5 * (h + l2) * w * w


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10, l2: float = 1.0) -> Forest:
    """Boosts ``trees`` trees of ``depth`` levels on logistic loss.

    ``monotone`` has +1 where the score may only rise with the feature, -1 where it may only fall, else 0. A split that breaks
    it is not taken, and both sides' later values are bounded by the midpoint of the split's values, so no deeper node can undo it.
    Without rows, or with one class only, the forest is empty and scores that class.
    """
    good = y.mean() if len(y) else 1.0
    base = float(np.log(np.clip(good, 1e-3, 1 - 1e-3) / np.clip(1 - good, 1e-3, 1)))
    nodes: list[list] = []
    roots: list[int] = []
    if 0 < good < 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        score = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            roots.append(len(nodes))
            nodes.append([])
            todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
            while todo:
                node, rows, level, low, high = todo.pop()
                best = (1e-9, None)
                gs, hs = g[rows], h[rows]
                if level < depth and len(rows) >= 2 * least:
                    w = _value(gs.sum(), hs.sum(), l2, low, high)
                    now = _loss(gs.sum(), hs.sum(), l2, w)
                    for j, e in enumerate(edges):
                        b = binned[rows, j]
                        gl, hl, n = (np.cumsum(np.bincount(b, weights, minlength=len(e) + 1))[:-1] for weights in (gs, hs, None))
                        wl, wr = _value(gl, hl, l2, low, high), _value(gs.sum() - gl, hs.sum() - hl, l2, low, high)
                        gain = now - _loss(gl, hl, l2, wl) - _loss(gs.sum() - gl, hs.sum() - hl, l2, wr)
                        gain[(n < least) | (len(rows) - n < least) | (monotone[j] * (wr - wl) < 0)] = -np.inf
                        if len(gain) and gain.max() > best[0]:
                            k = int(gain.argmax())
                            best = (gain[k], (j, k, float(wl[k]), float(wr[k])))
                if best[1] is None:
                    w = float(_value(gs.sum(), hs.sum(), l2, low, high)) * rate
                    nodes[node] = [-1, 0.0, node, node, w]
                    score[rows] += w
                    continue
                j, k, wl, wr = best[1]
                a, b = len(nodes), len(nodes) + 1
                nodes += [[], []]
                nodes[node] = [j, float(edges[j][k]), a, b, 0.0]
                mid = (wl + wr) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(monotone[j])]
                on_left = binned[rows, j] <= k
                todo += [(a, rows[on_left], level + 1, *bounds[0]), (b, rows[~on_left], level + 1, *bounds[1])]
    columns = list(zip(*nodes)) if nodes else [[]] * 5
    return Forest(np.array(roots, np.int64), np.array(columns[0], np.int64), np.array(columns[1]), np.array(columns[2], np.int64), np.array(columns[3], np.int64), np.array(columns[4]), base, depth)
