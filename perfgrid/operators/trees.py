"""Decision trees grown level by level from mergeable histograms.

A tree is a set of parallel lists: feature (-1: leaf, -2: still open), cut, first child, depth, path and
the channel sums of each node; the root's path is 1, those of children 2 p and 2 p + 1, modulo a prime. A round counts, for the open nodes only, the channel sums of every
(node, feature, bin); the splits follow from the counts alone, so counts of different blocks
are simply added. Channels are class weights, or residual, curvature and count for boosting.

Randomness is a rule on row hash, tree and node, so that results repeat anywhere.
"""

from __future__ import annotations

from math import exp, factorial

import numpy as np

PRIME = 2_147_483_647  # fixed value: the modulus of the random rule
STEP = 48_271  # fixed value: its multiplier
OPEN_NODES = 128  # nodes of one tree counted in one round; the others wait for the next

#: cumulative shares of the Poisson law with mean 1
POISSON = np.cumsum([exp(-1.0) / factorial(i) for i in range(9)])


def row_uniform(key: np.ndarray, tree: int) -> np.ndarray:
    """A number in [0, 1) for each row hash and tree."""
    times, plus = (2 * tree + 3) * 16_807 % PRIME, tree * 7_919 % PRIME
    r = ((key % PRIME) * times + plus) % PRIME
    return (r * STEP % PRIME) / PRIME


def draws(key: np.ndarray, tree: int) -> np.ndarray:
    """How often a row is in a tree's sample: Poisson with mean 1, the limit of drawing with replacement."""
    return (row_uniform(key, tree)[:, None] >= POISSON[None, :]).sum(axis=1).astype(np.float64)


def node_number(tree: int, path: int, feature: int) -> int:
    """The random number of a feature at a node: features with the least numbers are looked at."""
    v = ((tree + 1) * 1_000_003 + (path + 1) * 10_007 + (feature + 1) * 101) % PRIME
    return v * STEP % PRIME * STEP % PRIME


def node_uniform(tree: int, path: int, feature: int) -> float:
    return node_number(tree, path, feature) * 69_621 % PRIME / PRIME


class Tree:
    def __init__(self, sums: np.ndarray | None = None):
        self.feature, self.cut, self.child, self.depth, self.path, self.sums = [-2], [0.0], [-1], [0], [1], [sums]

    def open(self, limit: int = OPEN_NODES) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f == -2][:limit]

    def route(self, x: np.ndarray, node: np.ndarray | None = None) -> np.ndarray:
        """Node of each row of filled features; ``node``: where an earlier state of this tree had put them."""
        feature, cut, child = np.array(self.feature), np.array(self.cut), np.array(self.child)
        node = np.zeros(len(x), np.int64) if node is None else node.copy()
        moving = np.flatnonzero(feature[node] >= 0)
        while len(moving):
            at = node[moving]
            node[moving] = child[at] + (x[moving, feature[at]] > cut[at])
            moving = moving[feature[node[moving]] >= 0]
        return node

    def leaf(self, node: int) -> None:
        self.feature[node] = -1

    def split(self, node: int, feature: int, cut: float, left: np.ndarray, right: np.ndarray) -> None:
        self.feature[node], self.cut[node], self.child[node] = feature, cut, len(self.feature)
        for side, sums in enumerate((left, right)):
            self.feature.append(-2)
            self.cut.append(0.0)
            self.child.append(-1)
            self.depth.append(self.depth[node] + 1)
            self.path.append((2 * self.path[node] + side) % PRIME)
            self.sums.append(sums)


def histogram(tree: Tree, x: np.ndarray, codes: np.ndarray, channels: np.ndarray, bins: int) -> np.ndarray:
    """(open node, feature, bin, channel) sums over rows; ``channels`` is (row, channel)."""
    nodes = tree.open()
    slot = np.full(len(tree.feature), -1)
    slot[nodes] = np.arange(len(nodes))
    at = slot[tree.route(x)]
    rows = np.flatnonzero((at >= 0) & channels.any(axis=1))
    at, w = at[rows], channels[rows]
    out = np.zeros((len(nodes), codes.shape[1], bins, channels.shape[1]))
    for f in range(codes.shape[1]):
        place = at * bins + codes[rows, f]
        for c in range(channels.shape[1]):
            out[:, f, :, c] = np.bincount(place, weights=w[:, c], minlength=len(nodes) * bins).reshape(len(nodes), bins)
    return out


def tally(tree: Tree, node: np.ndarray, cells: np.ndarray, per: int, channels: list[np.ndarray | None], deepest: int, among: np.ndarray | None = None) -> np.ndarray:
    """(open node, feature, cell, channel) sums; ``node`` and the columns of ``cells`` (feature, row) are the rows to be
    counted (``among``: only some of them), a cell is below ``per``, a channel without weights counts rows. Where all open nodes are at the
    greatest depth, only their sums are wanted, so the first feature alone is counted."""
    nodes = tree.open()
    slot = np.full(len(tree.feature), -1)
    slot[nodes] = np.arange(len(nodes)) * per
    at = slot[node]
    out = np.zeros((len(nodes), len(cells), per, len(channels)))
    rows = np.flatnonzero(at >= 0 if among is None else (at >= 0) & among)
    some = len(rows) < len(at)
    if some:
        at, channels = at[rows], [w if w is None else w[rows] for w in channels]
    for f in range(1 if all(tree.depth[i] >= deepest for i in nodes) else len(cells)) if len(cells) else ():
        place = at + (cells[f][rows] if some else cells[f])
        for c, w in enumerate(channels):
            out[:, f, :, c] = np.bincount(place, weights=w, minlength=len(nodes) * per).reshape(len(nodes), per)
    return out


def impurity(sums: np.ndarray, criterion: str) -> np.ndarray:
    """Weight times Gini impurity or entropy, of class sums along the last axis."""
    n = sums.sum(axis=-1)
    safe = np.where(n > 0, n, 1.0)
    if criterion == "entropy":
        share = sums / safe[..., None]
        return -n * np.where(share > 0, share * np.log2(np.where(share > 0, share, 1.0)), 0.0).sum(axis=-1)
    return n - (sums * sums).sum(axis=-1) / safe


def class_score(left: np.ndarray, right: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity that a split leaves, for each weight of the node; twelve places, so that equal splits are ties."""
    n = left.sum(axis=-1) + right.sum(axis=-1)
    return np.round((impurity(left, criterion) + impurity(right, criterion)) / np.where(n > 0, n, 1.0), 12)


def residual_score(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minus Friedman's improvement; channels are residual, curvature, count. Nine places."""
    nl, nr = left[..., 2], right[..., 2]
    gap = left[..., 0] / np.where(nl > 0, nl, 1.0) - right[..., 0] / np.where(nr > 0, nr, 1.0)
    return -np.round(gap * gap * nl * nr / np.maximum(nl + nr, 1.0), 9)


class Splitter:
    """Best splits of many nodes at once from their histograms. ``exact``: the edges of a feature are all its
    distinct values, so that a cut lies halfway to the next value the node has; quantile edges bound their bins
    from above, and only the edge itself parts the rows as they were counted."""

    def __init__(self, edges: list[list[float]], full: int):
        self.bins, self.full = max([1, *(len(e) for e in edges)]), full
        self.exact = np.array([len(e) < full for e in edges], bool)
        self.values = np.array([[*e, *([np.inf] * (self.bins - len(e)))] for e in edges]).reshape(len(edges), self.bins)

    def varying(self, hist: np.ndarray, mass: int | None) -> np.ndarray:
        """(node, feature): whether the node has more than one bin."""
        return ((hist.sum(axis=3) if mass is None else hist[..., mass]) > 0).sum(axis=2) > 1

    def best(self, hist: np.ndarray, allowed: np.ndarray, score, mass: int | None, uniform: np.ndarray | None = None) -> list[tuple | None]:
        """For each node (feature, cut, left sums, right sums) of the least score, ties to the smaller feature and cut,
        or None. ``mass``: the channel that counts rows (None: all together); ``allowed`` (node, feature); with
        ``uniform`` only that random cut between a feature's extremes is looked at."""
        nodes, features, bins, _ = hist.shape
        if not nodes or not features:
            return [None] * nodes
        upto = hist.cumsum(axis=2)
        whole = upto[:, :, -1:, :]
        weight = hist.sum(axis=3) if mass is None else hist[..., mass]
        there, later = weight > 0, np.zeros(weight.shape, bool)
        later[:, :, :-1] = (there[:, :, ::-1].cumsum(axis=2)[:, :, ::-1] > 0)[:, :, 1:]
        able = there & later & allowed[:, :, None]
        cut = None
        if uniform is not None:
            first = there.argmax(axis=2)
            last = bins - 1 - there[:, :, ::-1].argmax(axis=2)
            lo, hi = (np.take_along_axis(np.broadcast_to(self.values, weight.shape), i[:, :, None], 2)[:, :, 0] for i in (first, last))
            with np.errstate(invalid="ignore"):
                cut = lo + uniform * (hi - lo)
            below = there & (np.broadcast_to(self.values, weight.shape) <= cut[:, :, None])
            at = bins - 1 - below[:, :, ::-1].argmax(axis=2)
            only = np.zeros(weight.shape, bool)
            np.put_along_axis(only, at[:, :, None], True, 2)
            able &= only
        scores = np.where(able, score(upto, whole - upto), np.inf)
        flat = scores.reshape(nodes, -1).argmin(axis=1)
        out: list[tuple | None] = []
        for n, i in enumerate(flat):
            f, b = divmod(int(i), bins)
            if not able[n, f, b]:
                out.append(None)
                continue
            point = self.values[f, b]
            if self.exact[f]:
                after = b + 1 + int(there[n, f, b + 1 :].argmax())
                point = cut[n, f] if cut is not None else (self.values[f, b] + self.values[f, after]) / 2
            out.append((f, float(point), upto[n, f, b].copy(), (whole[n, f, 0] - upto[n, f, b]).copy()))
        return out
