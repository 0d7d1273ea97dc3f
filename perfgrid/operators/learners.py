"""The estimators of the grid as additive statistics over blocks.

Each learner has the same four functions: ``start`` makes the state of one model; ``partial`` gives the
statistic of one block under that state, as named arrays that may be added; ``update`` turns the
state and the total into the next state, with ``done`` when the model is settled; ``predict`` names label
codes. Hyperparameters come as text from the grid. A training set with one class predicts it.

Features are filled with the training mean; linear models, networks and naive Bayes also standardize them.
"""

from __future__ import annotations

import math

import numpy as np

from perfgrid.operators import trees as T


def _constant(info: dict) -> dict | None:
    """State of a model whose training rows have one class only (or none)."""
    n = np.array(info["counts"])
    return {"constant": int(n.argmax()) if len(n) else 0, "done": True} if (n > 0).sum() < 2 else None


def _one_hot(data, info: dict) -> np.ndarray:
    def make():
        y = np.zeros((len(data.y), len(info["counts"])))
        rows = np.flatnonzero(data.training(info))
        y[rows, data.y[rows]] = 1.0
        return y

    return data.remember(("codes", "y", info["outer"]), make)


def _splitter(info: dict) -> T.Splitter:
    from perfgrid.operators.blocks import BINS

    return T.Splitter(info["edges"], BINS)


def _bins(info: dict) -> int:
    return max([1, *(len(e) for e in info["edges"])])


class Learner:
    #: (hyperparameter, default) that tells of how many models this learner is made
    parts: tuple[str, int] | None = None

    def start(self, h: dict, info: dict, part: int) -> dict:
        return _constant(info) or self.first(h, info, part)

    def predict(self, states: list[dict], data, rows: np.ndarray, h: dict, info: dict) -> np.ndarray:
        if "constant" in states[0]:
            return np.full(len(rows), states[0]["constant"])
        return self.codes(states, data, rows, h, info)

    def table(self, state: dict, info: dict) -> list[tuple]:
        """What a settled model holds, as rows (round, label, place, feature number, cut, value)."""
        return []


def _weights(w: np.ndarray, info: dict) -> list[tuple]:
    return [(0, c, j, j - 1 if j else None, None, float(v)) for c, row in zip(info["classes"], w) for j, v in enumerate(row)]


class Forest(Learner):
    """Decision tree, random forest and extremely randomized trees. Nodes with fewer than ``min_samples_split``
    (weighted) rows, pure ones and those at ``max_depth`` are leaves. Forests look at about the root of
    the number of features at each node and vote with class shares, as single trees do."""

    def __init__(self, trees: int | None, sampled: bool, random_cuts: bool):
        self.parts = None if trees is None else ("n_estimators", trees)
        self.sampled, self.random_cuts = sampled, random_cuts

    def first(self, h, info, part):
        return {"tree": T.Tree(), "part": part}

    def partial(self, state, data, h, info):
        bins, k, part = _bins(info), len(info["counts"]), state["part"]

        cells = data.remember((*data.binned(info), k), lambda: np.ascontiguousarray(data.codes(info).T) * k + data.y)  # bin and class
        on, w = data.training(info), None
        if self.sampled:
            w = data.remember(("drawn", part), lambda: T.draws(data.key, part))
            on &= w > 0
        hist = T.tally(state["tree"], data.nodes(state["tree"], info), cells, bins * k, [w], int(h.get("max_depth") or 10**9), on)
        return {"h": hist.reshape(*hist.shape[:2], bins, k)}

    def update(self, state, total, h, info):
        tree, part = state["tree"], state["part"]
        n, d = sum(info["counts"]), len(info["edges"])
        least = float(h.get("min_samples_split", "2"))
        least = max(2, math.ceil(least * n)) if least < 1 else max(2, int(least))
        deepest = int(h.get("max_depth") or 10**9)
        wanted = d if self.parts is None else int(h.get("max_features") or max(1, int(math.sqrt(d))))
        score = lambda a, b: T.class_score(a, b, h.get("criterion") or "gini")
        nodes, hist = tree.open(), total["h"]
        sums = hist[:, 0].sum(axis=1) if d else np.zeros((len(nodes), len(info["counts"])))
        splitter = _splitter(info)
        allowed = splitter.varying(hist, None)
        numbers = np.array([[T.node_number(part, tree.path[i], f) for f in range(d)] for i in nodes]).reshape(len(nodes), d)
        if wanted < d:  # features that do not vary here give way to the next ones in the same order
            order = np.where(allowed, numbers, T.PRIME)
            allowed &= order.argsort(axis=1, kind="stable").argsort(axis=1) < wanted
        uniform = (numbers * 69_621 % T.PRIME) / T.PRIME if self.random_cuts else None
        found = splitter.best(hist, allowed, score, None, uniform)
        grows = lambda i: tree.sums[i].sum() >= least and (tree.sums[i] > 0).sum() > 1 and tree.depth[i] < deepest
        for at, (node, own, split) in enumerate(zip(nodes, sums, found)):
            tree.sums[node] = own
            if not (grows(node) and split):
                tree.leaf(node)
                continue
            tree.split(node, *split)
            feature, cut, left, _ = split
            # sums of weights are whole numbers: where rows are routed as they were counted, a child that cannot grow is known
            if len(info["edges"][feature]) != splitter.full - 1 and (hist[at, feature][splitter.values[feature] <= cut].sum(axis=0) == left).all():
                for side in (tree.child[node], tree.child[node] + 1):
                    if not grows(side):
                        tree.leaf(side)
        return {**state, "done": not tree.open(1)}

    def shares(self, state: dict) -> np.ndarray:
        sums = np.array([s if s is not None else np.zeros_like(state["tree"].sums[0]) for s in state["tree"].sums])
        return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)

    def table(self, state, info):
        t = state["tree"]
        return [(state["part"], info["classes"][int(s.argmax())], p, f if f >= 0 else None, c if f >= 0 else None, float(s.sum())) for p, f, c, s in zip(t.path, t.feature, t.cut, t.sums)]

    def codes(self, states, data, rows, h, info):
        x, votes = data.filled(info)[rows], 0.0
        for s in states:
            votes = votes + self.shares(s)[s["tree"].route(x)]
        return np.round(votes, 9).argmax(axis=1)


class Boosting(Learner):
    """Gradient boosting of regression trees on the logistic loss, one tree a class and round (one alone for
    two classes). Splits take the greatest of Friedman's improvements, leaves a Newton step."""

    def first(self, h, info, part):
        n = np.array(info["counts"], float)
        share = np.maximum(n / n.sum(), 1e-12)
        two = len(n) == 2
        base = np.array([math.log(share[1] / share[0])]) if two else np.log(share)
        return {"base": base, "trees": [], "now": [T.Tree() for _ in base], "part": part}

    def margins(self, state, data, info, rate: float) -> np.ndarray:
        """Sums of the finished trees; kept for the block while this model is worked on."""
        base, upto, f = data.held.get(("margin", info["outer"]), (None, 0, None))
        if base is not state["base"]:
            upto, f = 0, np.repeat(state["base"][None, :], len(data.y), axis=0)
        for group in state["trees"][upto:]:
            f = f + rate * np.stack([values[data.nodes(tree, info, k)] for k, (tree, values) in enumerate(group)], axis=1)
        data.held["margin", info["outer"]] = (state["base"], len(state["trees"]), f)
        return f

    def partial(self, state, data, h, info):
        way = data.way(info)
        on = data.remember(("codes", "on", info["outer"]), lambda: np.flatnonzero(data.training(info)))
        cells = data.remember(("codes", "cells", *way), lambda: np.ascontiguousarray(data.codes(info)[on].T))
        base, count, r, c = data.held.get(("pull", info["outer"]), (None, 0, None, None))
        if base is not state["base"] or count != len(state["trees"]):  # all levels of a round have the same residuals
            f = self.margins(state, data, info, float(h.get("learning_rate", "0.1")))[on]
            y = _one_hot(data, info)[on]
            if f.shape[1] == 1:
                p = 1.0 / (1.0 + np.exp(-f))
                r, c = y[:, 1:2] - p, p * (1 - p)
            else:
                e = np.exp(f - f.max(axis=1, keepdims=True))
                p = e / e.sum(axis=1, keepdims=True)
                r = y - p
                c = np.abs(r) * (1 - np.abs(r))
            r, c = np.ascontiguousarray(r.T), np.ascontiguousarray(c.T)
            data.held["pull", info["outer"]] = (state["base"], len(state["trees"]), r, c)
        deepest = int(h.get("max_depth") or 3)
        return {str(k): T.tally(tree, data.nodes(tree, info, k)[on], cells, _bins(info), [r[k], c[k], None], deepest) for k, tree in enumerate(state["now"]) if tree.open(1)}

    def update(self, state, total, h, info):
        d = len(info["edges"])
        deepest, count = int(h.get("max_depth") or 3), len(state["trees"])
        wanted = max(1, int(math.log2(d))) if h.get("max_features") == "log2" and d else d
        splitter = _splitter(info)
        for k, tree in enumerate(state["now"]):
            nodes = tree.open()
            if not nodes:
                continue
            hist = total[str(k)]
            sums = hist[:, 0].sum(axis=1) if d else np.zeros((len(nodes), 3))
            allowed = splitter.varying(hist, 2)
            if wanted < d:
                numbers = np.array([[T.node_number(count * len(state["now"]) + k, tree.path[i], f) for f in range(d)] for i in nodes])
                allowed &= numbers.argsort(axis=1, kind="stable").argsort(axis=1) < wanted
            for node, own, split in zip(nodes, sums, splitter.best(hist, allowed, T.residual_score, 2)):
                tree.sums[node] = own
                able = own[2] >= 2 and tree.depth[node] < deepest
                tree.split(node, *split) if able and split else tree.leaf(node)
        if any(t.open(1) for t in state["now"]):
            return state
        many = len(state["now"])
        scale = 1.0 if many == 1 else (many - 1) / many
        leaves = [np.array([0.0 if s is None or abs(s[1]) < 1e-150 else scale * s[0] / s[1] for s in t.sums]) for t in state["now"]]
        grown = [*state["trees"], list(zip(state["now"], leaves))]
        for t in state["now"]:
            t.sums = [None] * len(t.sums)
        return {**state, "trees": grown, "now": [T.Tree() for _ in range(many)], "done": len(grown) >= int(h.get("n_estimators") or 100)}

    def table(self, state, info):
        names = info["classes"] if len(state["base"]) > 1 else info["classes"][1:]
        return [(r, c, p, f if f >= 0 else None, q if f >= 0 else None, float(v)) for r, group in enumerate(state["trees"]) for c, (t, values) in zip(names, group) for p, f, q, v in zip(t.path, t.feature, t.cut, values)]

    def codes(self, states, data, rows, h, info):
        f = self.margins(states[0], data, info, float(h.get("learning_rate", "0.1")))[rows]
        return (f[:, 0] > 0).astype(np.int64) if f.shape[1] == 1 else np.round(f, 9).argmax(axis=1)


class AdaBoost(Learner):
    """Boosted stumps (SAMME). Ends with the first stump no better than chance, or with one without error."""

    def first(self, h, info, part):
        return {"stumps": [], "common": int(np.argmax(info["counts"]))}

    def said(self, stump: tuple, x: np.ndarray) -> np.ndarray:
        feature, cut, low, high, _ = stump
        return np.where(x[:, feature] <= cut, low, high)

    def partial(self, state, data, h, info):
        x = data.filled(info)
        upto, last, w = data.held.get(("say", info["outer"]), (0, None, np.zeros(len(data.y))))
        if upto and not (len(state["stumps"]) >= upto and state["stumps"][upto - 1] is last):  # another model's
            upto, w = 0, np.zeros(len(data.y))
        for s in state["stumps"][upto:]:
            w = w + np.where(self.said(s, x) != data.y, 0.0, -s[4])
        if state["stumps"]:
            data.held["say", info["outer"]] = (len(state["stumps"]), state["stumps"][-1], w)
        y = _one_hot(data, info) * np.exp(w)[:, None]
        return {"h": T.histogram(T.Tree(), x, data.codes(info), y, _bins(info))}

    def update(self, state, total, h, info):
        hist, classes = total["h"][0], len(info["counts"])
        every = np.ones((1, len(info["edges"])), bool)
        (found,) = _splitter(info).best(hist[None], every, lambda a, b: T.class_score(a, b, "gini"), None)
        if found is None:
            return {**state, "done": True}
        feature, cut, left, right = found
        low, high = int(np.argmax(left)), int(np.argmax(right))
        error = 1.0 - (left.max() + right.max()) / (left.sum() + right.sum())
        present = sum(n > 0 for n in info["counts"])
        if error >= 1.0 - 1.0 / present - 1e-12:
            return {**state, "done": True}
        say = float(h.get("learning_rate", "1.0")) * (math.log((1.0 - error) / max(error, 1e-12)) + math.log(max(present - 1, 1)))
        stumps = [*state["stumps"], (feature, cut, low, high, say)]
        return {**state, "stumps": stumps, "classes": classes, "done": error <= 1e-12 or len(stumps) >= int(h.get("n_estimators") or 50)}

    def table(self, state, info):
        return [(r, info["classes"][side], p, f, cut, float(say)) for r, (f, cut, low, high, say) in enumerate(state["stumps"]) for p, side in ((2, low), (3, high))]

    def codes(self, states, data, rows, h, info):
        x, score = data.filled(info)[rows], np.zeros((len(rows), len(info["counts"])))
        for s in states[0]["stumps"]:
            score[np.arange(len(rows)), self.said(s, x)] += s[4]
        return np.round(score, 9).argmax(axis=1) if states[0]["stumps"] else np.full(len(rows), states[0]["common"])


class Convex(Learner):
    """One-vs-rest logistic regression or linear machine with squared hinge, C times the loss plus the penalty;
    the bias is free. Its table has the violations as round 1. Newton steps with backtracking: a pass gives loss, gradient and curvature at the trial
    point. Settled when the greatest violation of optimality, for each unit of C and row, is below 1e-9."""

    def __init__(self, loss: str):
        self.loss = loss

    def first(self, h, info, part):
        k, d = len(info["counts"]), len(info["fill"]) + 1
        return {"w": np.zeros((k, d)), "trial": np.zeros((k, d)), "step": np.zeros((k, d)), "t": np.ones(k), "f": np.full(k, np.inf), "slope": np.zeros(k), "settled": np.zeros(k, bool), "violation": np.full(k, np.inf), "passes": 0}

    def partial(self, state, data, h, info):
        on = np.flatnonzero(data.training(info))
        z = data.remember(("scaled", "rows", *data.way(info)), lambda: np.ascontiguousarray(data.scaled(info)[on].T))  # (feature, row)
        y, k, d = data.y[on], len(info["counts"]), len(z)
        loss, grad, curve = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
        for c in np.flatnonzero(~state["settled"]):
            sign = np.where(y == c, 1.0, -1.0)
            m = sign * (state["trial"][c] @ z)
            if self.loss == "logistic":
                e = np.exp(-np.abs(m))  # one exponential serves loss and curvature, and never overflows
                p = np.where(m >= 0, e, 1.0) / (1.0 + e)
                each, pull, bend = np.maximum(-m, 0.0) + np.log1p(e), -sign * p, p * (1 - p)
                loss[c], grad[c], curve[c] = each.sum(), z @ pull, (z * bend) @ z.T
            else:  # rows beyond the margin add nothing
                near = m < 1.0
                zn, gap = z[:, near], 1.0 - m[near]
                loss[c], grad[c], curve[c] = gap @ gap, zn @ (-2.0 * sign[near] * gap), 2.0 * (zn @ zn.T)
        return {"loss": loss, "grad": grad, "curve": curve, "n": np.array(float(len(on)))}

    def update(self, state, total, h, info):
        s = {name: v.copy() if isinstance(v, np.ndarray) else v for name, v in state.items()}
        cost, first_norm = float(h.get("C", "1")), h.get("penalty") == "l1"
        unit = cost * max(1.0, float(total["n"]))
        for c in np.flatnonzero(~s["settled"]):
            w = s["trial"][c]
            size = np.abs(w[1:]).sum() if first_norm else 0.5 * (w[1:] @ w[1:])
            f = cost * total["loss"][c] + size
            if f > s["f"][c] + 1e-4 * s["t"][c] * s["slope"][c] + 1e-12 * abs(s["f"][c]) and s["t"][c] > 1e-10:
                s["t"][c] /= 2
                s["trial"][c] = s["w"][c] + s["t"][c] * s["step"][c]
                continue
            s["w"][c], s["f"][c], s["t"][c] = w, f, 1.0
            g, q = cost * total["grad"][c], cost * total["curve"][c] + 1e-9 * unit * np.eye(len(w))
            if first_norm:
                soft = lambda v, a: np.sign(v) * np.maximum(np.abs(v) - a, 0.0)
                away = np.concatenate([g[:1], (w - soft(w - g / unit, 1.0 / unit))[1:] * unit])
                step = self.first_norm_step(w, g, q)
                s["slope"][c] = g @ step + np.abs((w + step)[1:]).sum() - np.abs(w[1:]).sum()
            else:
                away = g + np.concatenate([[0.0], w[1:]])
                step = -np.linalg.solve(q + np.diag([0.0] + [1.0] * (len(w) - 1)), away)
                s["slope"][c] = away @ step
            s["violation"][c] = np.abs(away).max() / unit
            s["step"][c], s["trial"][c] = step, w + step
            s["settled"][c] = s["violation"][c] < 1e-9
        s["passes"] += 1
        s["done"] = bool(s["settled"].all()) or s["passes"] >= 500
        return s

    @staticmethod
    def first_norm_step(w: np.ndarray, g: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Least of the quadratic model plus the absolute values, by coordinates."""
        step, bent = np.zeros_like(w), np.zeros_like(w)
        for _ in range(10_000):
            most = 0.0
            for j in range(len(w)):
                pull = g[j] + bent[j]
                if j == 0:
                    move = -pull / q[0, 0]
                else:
                    at = w[j] + step[j] - pull / q[j, j]
                    move = math.copysign(max(abs(at) - 1.0 / q[j, j], 0.0), at) - w[j] - step[j]
                if move:
                    step[j] += move
                    bent += q[:, j] * move
                    most = max(most, abs(move) * math.sqrt(q[j, j]))
            if most < 1e-13 * (1.0 + math.sqrt(float(np.abs(g).max()))):
                break
        return step

    def table(self, state, info):
        return [*_weights(state["w"], info), *((1, c, 0, None, None, float(v)) for c, v in zip(info["classes"], state["violation"]))]

    def codes(self, states, data, rows, h, info):
        seen = np.array(info["counts"]) > 0
        score = data.scaled(info)[rows] @ states[0]["w"].T
        return np.where(seen[None, :], np.round(score, 9), -np.inf).argmax(axis=1)


class Perceptron(Learner):
    """One-vs-rest perceptron with the whole training set as one step; the weights of the pass with the
    fewest errors are kept."""

    def first(self, h, info, part):
        k, d = len(info["counts"]), len(info["fill"]) + 1
        return {"w": np.zeros((k, d)), "best": np.zeros((k, d)), "least": np.full(k, np.inf), "passes": 0}

    def partial(self, state, data, h, info):
        on = np.flatnonzero(data.training(info))
        z, sign = data.scaled(info)[on], np.where(data.y[on][:, None] == np.arange(len(info["counts"])), 1.0, -1.0)
        wrong = (sign * (z @ state["w"].T) <= 0) * sign
        return {"g": wrong.T @ z, "errors": np.abs(wrong).sum(axis=0)}

    def update(self, state, total, h, info):
        better = total["errors"] < state["least"]
        best = np.where(better[:, None], state["w"], state["best"])
        passes = state["passes"] + 1
        done = passes > int(h.get("max_iter") or 100) or not total["errors"].any()
        return {"w": state["w"] + total["g"], "best": best, "least": np.minimum(state["least"], total["errors"]), "passes": passes, "done": done}

    def table(self, state, info):
        return _weights(state["best"], info)

    def codes(self, states, data, rows, h, info):
        return np.round(data.scaled(info)[rows] @ states[0]["best"].T, 9).argmax(axis=1)


class NaiveBayes(Learner):
    """Gaussian naive Bayes; variances get 1e-9 of the largest feature variance."""

    def first(self, h, info, part):
        return {}

    def partial(self, state, data, h, info):
        z, y = data.scaled(info)[:, 1:], _one_hot(data, info)
        return {"n": y.sum(axis=0), "one": y.T @ z, "two": y.T @ (z * z)}

    def update(self, state, total, h, info):
        n = np.maximum(total["n"], 1.0)[:, None]
        mean = total["one"] / n
        var = np.maximum(total["two"] / n - mean * mean, 0.0)
        whole = total["two"].sum(axis=0) / n.sum() - (total["one"].sum(axis=0) / n.sum()) ** 2
        var = var + 1e-9 * max(float(whole.max(initial=0.0)), 1e-300)
        with np.errstate(divide="ignore"):
            base = np.log(total["n"] / total["n"].sum()) - 0.5 * np.log(2 * math.pi * var).sum(axis=1)
        return {"mean": mean, "half": 0.5 / var, "base": base, "done": True}

    def codes(self, states, data, rows, h, info):
        z, s = data.scaled(info)[rows][:, 1:], states[0]
        score = s["base"][None, :] - np.stack([((z - m) ** 2 * a).sum(axis=1) for m, a in zip(s["mean"], s["half"])], axis=1)
        return np.round(score, 9).argmax(axis=1)


class Network(Learner):
    """One hidden layer of rectified units and a softmax, trained by mini-batches in hash order with adam or with
    momentum, and the squared weight penalty ``alpha``. A round is one epoch: every block goes through its
    rows from the same start, and weights and moments are averaged by rows. A dataset of one block is
    trained as usual. Rates of ``adaptive`` momentum fall by five when the loss has not gained 1e-4 in ten
    epochs; adam ends then."""

    def first(self, h, info, part):
        d, k, hidden = len(info["fill"]), len(info["counts"]), int(h.get("hidden") or 100)
        rng = np.random.default_rng(17)
        shapes = [(d, hidden), (hidden,), (hidden, k), (k,)]
        reach = [math.sqrt((6.0 if i < 2 else 2.0) / (a + b)) for i, (a, b) in enumerate([(d, hidden), (d, hidden), (hidden, k), (hidden, k)])]
        w = np.concatenate([rng.uniform(-r, r, s).ravel() for r, s in zip(reach, shapes)])
        return {"w": w, "m": np.zeros_like(w), "v": np.zeros_like(w), "t": 0, "shapes": shapes, "rate": float(h.get("learning_rate_init", "0.001")), "least": math.inf, "still": 0, "epoch": 0}

    @staticmethod
    def parts_of(w: np.ndarray, shapes: list[tuple]) -> list[np.ndarray]:
        at = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        return [w[a:b].reshape(s) for a, b, s in zip(at, at[1:], shapes)]

    def gradient(self, w: np.ndarray, shapes: list[tuple], x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
        g = np.empty_like(w)
        loss = self.slope(self.parts_of(w, shapes), self.parts_of(g, shapes), x, y, y.argmax(axis=1), alpha)
        return loss, g

    @staticmethod
    def slope(parts: list[np.ndarray], into: list[np.ndarray], x: np.ndarray, y: np.ndarray, on: np.ndarray, alpha: float) -> float:
        """Loss of some rows, of classes ``on``; its gradient goes ``into`` arrays of the shapes of ``parts``."""
        (w1, b1, w2, b2), (g1, c1, g2, c2), n = parts, into, len(x)
        hidden = x @ w1
        hidden += b1
        np.maximum(hidden, 0.0, out=hidden)
        p = hidden @ w2
        p += b2
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        loss = -np.log(np.maximum(np.take_along_axis(p, on[:, None], 1), 1e-300)).mean() + 0.5 * alpha * ((w1 * w1).sum() + (w2 * w2).sum()) / n
        p -= y
        p /= n
        np.matmul(hidden.T, p, out=g2)
        g2 += alpha * w2 / n
        p.sum(axis=0, out=c2)
        down = p @ w2.T
        down *= hidden > 0
        np.matmul(x.T, down, out=g1)
        g1 += alpha * w1 / n
        down.sum(axis=0, out=c1)
        return loss

    def partial(self, state, data, h, info):
        on = np.flatnonzero(data.training(info))
        order = on[np.argsort(T.row_uniform(data.key[on], state["epoch"]), kind="stable")]
        x, y, code, alpha = data.scaled(info)[order, 1:], _one_hot(data, info)[order], data.y[order], float(h.get("alpha", "0.0001"))
        w, m, v, t = state["w"].copy(), state["m"].copy(), state["v"].copy(), state["t"]
        g = np.empty_like(w)
        parts, into = self.parts_of(w, state["shapes"]), self.parts_of(g, state["shapes"])
        size, total = int(h.get("batch_size") or 200), 0.0
        for a in range(0, len(order), size):
            rows = slice(a, a + size)
            loss = self.slope(parts, into, x[rows], y[rows], code[rows], alpha)
            total += loss * len(code[rows])
            t += 1
            if h.get("solver") == "sgd":
                m = 0.9 * m - state["rate"] * g
                w[:] = w + 0.9 * m - state["rate"] * g
            else:
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w -= state["rate"] * math.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
        n = float(len(order))
        return {"w": w * n, "m": m * n, "v": v * n, "loss": np.array(total), "n": np.array(n), "t": np.array(t * n)}

    def update(self, state, total, h, info):
        n = max(float(total["n"]), 1.0)
        loss, s = float(total["loss"]) / n, dict(state)
        s.update({name: total[name] / n for name in ("w", "m", "v")}, t=int(round(float(total["t"]) / n)), epoch=state["epoch"] + 1)
        s["still"] = state["still"] + 1 if loss > state["least"] - 1e-4 else 0
        s["least"] = min(state["least"], loss)
        if s["still"] > 10:
            if h.get("solver") == "sgd" and h.get("learning_rate") == "adaptive" and state["rate"] > 1e-6:
                s["rate"], s["still"] = state["rate"] / 5, 0
            else:
                s["done"] = True
        s["done"] = s.get("done", False) or s["epoch"] >= int(h.get("max_iter") or 200)
        return s

    def codes(self, states, data, rows, h, info):
        w1, b1, w2, b2 = self.parts_of(states[0]["w"], states[0]["shapes"])
        x = data.scaled(info)[rows][:, 1:]
        out = np.maximum(x @ w1 + b1, 0.0) @ w2 + b2
        return np.where(np.array(info["counts"])[None, :] > 0, np.round(out, 9), -np.inf).argmax(axis=1)


LEARNERS: dict[str, Learner] = {
    "DT": Forest(None, False, False),
    "RF": Forest(100, True, False),
    "ExtraTrees": Forest(100, False, True),
    "GBT": Boosting(),
    "AB": AdaBoost(),
    "lSVM": Convex("squared_hinge"),
    "Logit": Convex("logistic"),
    "Perceptron": Perceptron(),
    "GNB": NaiveBayes(),
    "MLP": Network(),
}
