"""Gradient-boosted trees and a lasso for logistic loss, fitted by sums over all training rows; see ``training``."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np

from .training import ONE, Block, Rows


@dataclass
class Tree:
    """Node k: ``x[feature] <= threshold`` goes to ``left``, else to ``right``; leaves have feature -1.  Binned rows go left if the bin is at most ``cut``."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for x, v in ((self.feature, -1), (self.threshold, 0.0), (self.cut, -1), (self.left, -1), (self.right, -1), (self.value, value)):
            x.append(v)
        return len(self.value) - 1

    def leaf(self, x: np.ndarray, binned: bool = True) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, threshold, left, right = map(np.array, (self.feature, self.cut if binned else self.threshold, self.left, self.right))
        while len(live := np.flatnonzero(feature[at] >= 0)):
            k = at[live]
            at[live] = np.where(x[live, feature[k]] <= threshold[k], left[k], right[k])
        return at

    def value_of(self, node: np.ndarray) -> np.ndarray:
        return np.array(self.value)[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value_of(self.leaf(x, binned=False))

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """The conditions (feature, whether ``<=``, threshold) from the root to every other node."""
        found: list[tuple[tuple[int, bool, float], ...]] = []
        todo: list[tuple[int, tuple]] = [(0, ())]
        while todo:
            k, path = todo.pop()
            if path:
                found.append(path)
            if self.feature[k] >= 0:
                f, t = self.feature[k], self.threshold[k]
                todo += [(self.left[k], (*path, (f, True, t))), (self.right[k], (*path, (f, False, t)))]
        return found


def sums(block: Block, start: float, trees: list[Tree]) -> np.ndarray:
    """The start value plus what each tree gives for the rows of a block, in this order."""
    n, f = block.f if block.f and block.f[0] <= len(trees) else (0, np.full(len(block.y), start))
    for tree in trees[n:]:
        f = f + tree.value_of(tree.leaf(block.x))
    block.f = (len(trees), f)
    return f


def _histograms(block: Block, start: float, trees: list[Tree], tree: Tree, live: list[int], width: int, skip: int) -> np.ndarray:
    """Gradients, curvatures and rows by node of ``live``, feature and bin."""
    p = 1 / (1 + np.exp(-sums(block, start, trees)))
    place = np.full(len(tree.value), -1)
    place[live] = np.arange(len(live))
    at = place[tree.leaf(block.x)]
    at[block.part & skip > 0] = -1
    on = np.flatnonzero(at >= 0)
    m = block.x.shape[1]
    spot = ((at[on][:, None] * m + np.arange(m)) * width + block.x[on]).ravel()
    p = p[on]
    each = (np.rint((block.y[on] - p) * ONE), np.rint(p * (1 - p) * ONE), np.ones(len(on)))
    return np.stack([np.bincount(spot, np.repeat(w, m), len(live) * m * width) for w in each]).astype(np.int64).ravel()


def boost(rows: Rows, n_trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 8, ridge: float = 1.0, skip: int = 0) -> tuple[float, list[Tree]]:
    """The start value and the trees; a single class gives no trees.  Every row counts in every tree, but those with a mark in ``skip``."""
    n, ones = (int(v) for v in np.resize(rows.total(lambda b: np.array([(b.part & skip == 0).sum(), b.y[b.part & skip == 0].sum()], np.int64)), 2))
    mean = float(np.clip(ones / n if n else 0.5, 1e-4, 1 - 1e-4))
    start = float(np.log(mean / (1 - mean)))
    if ones in (0, n):
        return start, []
    m, width = len(rows.cuts), max(len(c) for c in rows.cuts) + 1
    trees: list[Tree] = []
    for _ in range(n_trees):
        tree = Tree()
        live = [tree.add(0.0)]
        for _ in range(depth):
            got = rows.total(functools.partial(_histograms, start=start, trees=trees, tree=tree, live=live, width=width, skip=skip))
            grown = []
            for k, (g, h, c) in zip(live, got.reshape(3, len(live), m, width).transpose(1, 0, 2, 3), strict=True):
                g, h, c = np.cumsum(g, 1) / ONE, np.cumsum(h, 1) / ONE, np.cumsum(c, 1)
                all_g, all_h, all_c = g[0, -1], h[0, -1], c[0, -1]
                tree.value[k] = rate * float(all_g / (all_h + ridge))
                ok = (c >= least) & (all_c - c >= least) & (np.arange(width) < np.array([len(x) for x in rows.cuts])[:, None])
                gain = np.where(ok, g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge), -1)
                j, i = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, i] > 1e-6:
                    tree.feature[k], tree.cut[k], tree.threshold[k] = int(j), int(i), float(rows.cuts[j][i])
                    tree.left[k] = tree.add(rate * float(g[j, i] / (h[j, i] + ridge)))
                    tree.right[k] = tree.add(rate * float((all_g - g[j, i]) / (all_h - h[j, i] + ridge)))
                    grown += [tree.left[k], tree.right[k]]
            live = grown
            if not live:
                break
        trees.append(tree)
    return start, trees


def holds(path, x: np.ndarray) -> np.ndarray:
    """Rows for which all conditions (feature, whether ``<=``, number or bin) hold."""
    out = np.ones(len(x), bool)
    for j, low, t in path:
        out &= (x[:, j] <= t) if low else (x[:, j] > t)
    return out


def _matrix(block: Block, paths: list) -> np.ndarray:
    """A column of ones, and one of 0 and 1 for each path."""
    x = np.asfortranarray(block.x)
    return np.stack([np.ones(len(x), np.float32), *(holds(p, x).astype(np.float32) for p in paths)], 1)


def together(rows: Rows, paths: list) -> np.ndarray:
    """In how many rows two paths hold together; path 0 always holds."""

    def of(block: Block) -> np.ndarray:
        a = _matrix(block, paths)
        return (a.T @ a).astype(np.int64).ravel()

    return np.resize(rows.total(of), (len(paths) + 1, len(paths) + 1))


_CURVE = 1 << 12  # what stands for 1 in curvatures: a block's sums of them, at most a quarter each, are whole in single precision


def _slopes(block: Block, paths: list, w: np.ndarray, skip: int) -> np.ndarray:
    """Of a logistic regression: loss and rows in use, loss and rows left out, gradient, curvature."""
    a = _matrix(block, paths)
    z = np.full(len(a), w[0])
    for k in np.flatnonzero(w[1:]) + 1:
        z += w[k] * a[:, k]
    use = block.part & skip == 0
    p = 1 / (1 + np.exp(-z))
    loss = np.rint((np.logaddexp(0, z) - block.y * z) * ONE)
    head = [loss[use].sum(), use.sum(), loss[~use].sum(), (~use).sum()]
    grad = np.rint((p - block.y) * ONE * use) @ a.astype(np.float64)
    # Where the curve is nearly flat a little more is taken for it, which only shortens steps.
    curve = (np.maximum(np.rint(p * (1 - p) * _CURVE), _CURVE >> 6) * use).astype(np.float32)
    return np.concatenate([head, grad, (a.T @ (a * curve[:, None])).ravel()]).astype(np.int64)


def _step(w: np.ndarray, grad: np.ndarray, curve: np.ndarray, cost: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """The weights that are least in the quadratic around ``w`` plus ``cost`` times their sizes, by accelerated proximal steps."""
    size = 1 / max(float(np.linalg.norm(curve, 2)), 1e-12)
    v = z = w
    t = 1.0
    for _ in range(rounds):
        new = z - size * (grad + curve @ (z - w))
        new = np.sign(new) * np.maximum(np.abs(new) - size * cost, 0)
        if np.abs(new - z).max() < 1e-9:
            return new
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, v, t = new + (t - 1) / after * (new - v), new, after
    return v


def lasso(rows: Rows, paths: list, scale: np.ndarray, penalty: float, w: np.ndarray, skip: int = 0, most: int = 12) -> tuple[np.ndarray, float]:
    """Intercept and weights of a logistic regression on the paths with an L1 penalty (on weights times ``scale``), from ``w``, by proximal Newton steps.

    Also the mean loss of the rows with a mark in ``skip``, which are left out of the fit.
    """
    d = len(paths) + 1
    unit = np.append(1.0, scale)  # weights are those of columns divided by their scale
    cost = np.append(0.0, np.full(d - 1, penalty))

    def at(v: np.ndarray):
        s = rows.total(functools.partial(_slopes, paths=paths, w=v / unit, skip=skip))
        n = max(int(s[1]), 1)
        out = s[2] / ONE / max(int(s[3]), 1)
        return s[0] / ONE / n + float(cost @ np.abs(v)), out, s[4 : 4 + d] / ONE / n / unit, s[4 + d :].reshape(d, d) / _CURVE / n / np.outer(unit, unit)

    v = w * unit
    now = at(v)
    for _ in range(most):
        to = _step(v, now[2], now[3], cost)
        new = at(to)
        for _ in range(4):
            if new[0] <= now[0]:
                break
            to = (v + to) / 2
            new = at(to)
        if new[0] > now[0]:
            break
        gain, v, now = now[0] - new[0], to, new
        if gain < 1e-5:
            break
    return v / unit, float(now[1])
