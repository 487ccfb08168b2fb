"""Gradient-boosted trees with logistic loss over a bounded dense sample, and isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees stored level by level: feature, threshold (right if x > t), leaf values."""

    depth: int
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, smooth: float = 4.0) -> Trees:
    """Newton boosting on quantile histograms. Deterministic for the same rows in the same order."""
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    model = Trees(depth, float(np.log(mean / (1 - mean))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    raw = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p) + 1e-9
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-6)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * (bins + 1) + code[:, j]
                gs = np.bincount(key, g, width * (bins + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(key, h, width * (bins + 1)).reshape(width, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
                gain = gain[:, : len(c)]
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                won = top > best
                best = np.where(won, top, best)
                feature[first : first + width][won] = j
                threshold[first : first + width][won] = c[at[won]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        slot = node - inner
        leaf = -rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + smooth)
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.leaf.append(leaf)
        raw += leaf[slot]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y by score (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    s, values = score[order], y[order].astype(float)
    blocks: list[list[float]] = []  # sum, weight, lowest score, highest score
    for a, v in zip(s, values):
        blocks.append([v, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            total, weight, _, high = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += weight
            blocks[-1][3] = high
    knots, levels = [], []
    for total, weight, low, high in blocks:
        for k in (low, high) if high > low else (low,):
            knots.append(k)
            levels.append(total / weight)
    return np.array(knots), np.array(levels)
