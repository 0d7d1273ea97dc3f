"""Batched learners: the same model from one block or many, brute force on small tables, whole grid."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perfgrid.functions import metrics as M
from perfgrid.operators import blocks as B
from perfgrid.operators import learners as L
from perfgrid.operators import neighbours
from perfgrid.operators import runner as R
from perfgrid.operators import trees as T
from perfgrid.operators.splits import stratified_folds
from perfgrid.plans import q_grid as G
from perfgrid.sources.grids import ESTIMATORS, settings

SETTINGS = {
    "DT": {"min_samples_split": "8"}, "RF": {"n_estimators": "3", "min_samples_split": "0.05"}, "ExtraTrees": {"n_estimators": "3", "min_samples_split": "8"},
    "GBT": {"n_estimators": "3", "max_depth": "2", "max_features": "log2"}, "AB": {"n_estimators": "4"}, "lSVM": {"C": "0.5"}, "Logit": {"C": "2", "penalty": "l1"},
    "Perceptron": {"max_iter": "5"}, "GNB": {}, "KNN": {"n_neighbors": "3", "p": "1"},
}


def rows_of(spark, n=360, datasets=3, classes=3, missing=True):
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        d = i % datasets
        x = [float(rng.integers(0, 12)), float(rng.integers(0, 5)), round(float(rng.normal()), 1)]
        y = "abc"[int(x[0] > 5) + int(x[1] > 2 and classes > 2)] if rng.random() < 0.85 else "abc"[int(rng.integers(classes))]
        if d == 2:
            y = "a" if i % 2 == 0 or datasets < 3 else y
        out.append((d, i, *x[:2], None if missing and rng.random() < 0.1 else x[2], y, int(rng.integers(5)), int(rng.integers(2**60))))
    return spark.createDataFrame(out, "dataset_id int, row_id int, u double, v double, w double, label string, fold int, key long")


def packed(spark, rows, **kw):
    return B.pack(rows, ["dataset_id"], "label", ["u", "v", "w"], F.col("key"), 5, ["row_id"], **kw)


@pytest.fixture(scope="module")
def rows(spark):
    return rows_of(spark).cache()


def configs():
    return [{"config_id": i, "algorithm": a, "hyperparameters": h, "imputer": ["mean", "median"][i % 2]} for i, (a, h) in enumerate(SETTINGS.items())]


def test_blocks_do_not_matter(spark, rows):
    """Rounds over many blocks give what one block gives, for every learner that is an exact sum."""
    out = []
    for size in (1000, 17):
        b = packed(spark, rows, block_rows=size, imputers=["mean", "median"])
        assert (b.frame.count() == 3) == (size == 1000)
        tasks = R.tasks_of(rows, ["dataset_id"], configs())
        models = R.fit(b, tasks)
        counts = R.confusion(b, tasks, models)
        out.append(sorted(map(tuple, counts.select("dataset_id", "config_id", "fold", "_y", "_p", "_n").collect())))
        every = R.predictions(b, tasks, models)
        assert every.count() == 360 * len(SETTINGS)
        again = M.ber(every, ["dataset_id", "config_id", "fold"]).groupBy("dataset_id", "config_id").agg(F.avg("ber").alias("e")).collect()
        table = {(r.dataset_id, r.config_id): r.error for r in R.performance(b, tasks, models=models).collect()}
        assert {(r.dataset_id, r.config_id) for r in again} == set(table) and all(abs(table[r.dataset_id, r.config_id] - r.e) < 1e-12 for r in again)
    assert out[0] == out[1]


def data_of(rows, dataset=0, outer=0):
    part = sorted((r for r in rows if r.dataset_id == dataset), key=lambda r: r.key)
    x = np.array([[r.u, r.v, math.nan if r.w is None else r.w] for r in part], float)
    y = np.array(["abc".index(r.label) for r in part], np.int32)
    fold = np.array([r.fold for r in part], np.int8)
    on = fold != outer
    fill = np.nanmean(x[on], axis=0)
    z = np.where(np.isnan(x), fill, x)
    info = {"outer": outer, "imputer": "mean", "standardize": True, "classes": list("abc"), "counts": np.bincount(y[on], minlength=3).tolist(), "fill": fill.tolist(), "shift": z[on].mean(0).tolist(), "sd": z[on].std(0).tolist()}
    info["edges"] = [sorted({*x[~np.isnan(x[:, f]), f].tolist(), float(fill[f])}) for f in range(3)]
    key = np.array([r.key for r in part], np.int64)
    return B.Data({"x": x.tobytes(), "y": y.tobytes(), "fold": fold.tobytes(), "key": key.tobytes()}, 3), info, z, y, on


def settle(learner, data, info, h):
    s = learner.start(h, info, 0)
    while not s.get("done"):
        s = learner.update(s, learner.partial(s, data, h, info), h, info)
    return s


def test_tree_against_all_splits(rows):
    data, info, z, y, on = data_of(rows.collect())
    t = settle(L.LEARNERS["DT"], data, info, {"min_samples_split": "20"})["tree"]

    def gini(rows):
        n = np.bincount(y[rows], minlength=3)
        return n.sum() - (n * n).sum() / n.sum()

    def grow(rows, node):
        if len(rows) < 20 or len(set(y[rows])) < 2:
            assert t.feature[node] == -1 and t.sums[node].tolist() == np.bincount(y[rows], minlength=3).tolist()
            return 1
        best = None
        for f in range(3):
            values = sorted(set(z[rows, f]))
            for a, b in zip(values, values[1:]):
                left, right = rows[z[rows, f] <= a], rows[z[rows, f] > a]
                s = round((gini(left) + gini(right)) / len(rows), 12)
                if best is None or s < best[0]:
                    best = (s, f, (a + b) / 2)
        assert (t.feature[node], round(t.cut[node], 9)) == (best[1], round(best[2], 9))
        go = z[rows, best[1]] <= best[2]
        return 1 + grow(rows[go], t.child[node]) + grow(rows[~go], t.child[node] + 1)

    assert grow(np.flatnonzero(on), 0) == len(t.feature) > 5


@pytest.mark.parametrize("name,h", [("Logit", {"C": "0.7"}), ("Logit", {"C": "0.7", "penalty": "l1"}), ("Logit", {"C": "0.01", "penalty": "l1"}), ("lSVM", {"C": "3"})])
def test_convex_optimum(rows, name, h):
    """No small step improves the objective, and the reported violation agrees with its gradient."""
    data, info, z, y, on = data_of(rows.collect())
    s = settle(L.LEARNERS[name], data, info, h)
    x = np.concatenate([np.ones((len(z), 1)), (z - info["shift"]) / np.array(info["sd"])], axis=1)[on]
    c = float(h["C"])

    def cost(w, k):
        m = np.where(y[on] == k, 1.0, -1.0) * (x @ w)
        loss = np.logaddexp(0, -m).sum() if name == "Logit" else (np.maximum(0, 1 - m) ** 2).sum()
        return c * loss + (np.abs(w[1:]).sum() if h.get("penalty") == "l1" else 0.5 * w[1:] @ w[1:])

    assert (s["violation"] < 1e-9).all() and s["passes"] < 60
    for k in range(3):
        here = cost(s["w"][k], k)
        for j, step in itertools.product(range(4), (1e-4, -1e-4, 1e-2, -1e-2)):
            w = s["w"][k].copy()
            w[j] += step
            assert cost(w, k) >= here - 1e-9


def test_boosting_lowers_loss_and_network_gradient(rows):
    data, info, z, y, on = data_of(rows.collect())
    losses = []
    for n in ("1", "5", "25"):
        learner, h = L.LEARNERS["GBT"], {"n_estimators": n, "learning_rate": "0.25"}
        f = learner.margins(settle(learner, data, info, h), data, info, 0.25)[on]
        losses.append((np.log(np.exp(f).sum(axis=1)) - f[np.arange(on.sum()), y[on]]).mean())
    assert losses[0] > losses[1] > losses[2]
    net = L.LEARNERS["MLP"]
    s = net.first({"hidden": "4"}, info, 0)
    x, hot = data.scaled(info)[:, 1:], np.eye(3)[y]
    _, g = net.gradient(s["w"], s["shapes"], x, hot, 0.3)
    for i in range(0, len(s["w"]), 5):
        up, down = s["w"].copy(), s["w"].copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert g[i] == pytest.approx((net.gradient(up, s["shapes"], x, hot, 0.3)[0] - net.gradient(down, s["shapes"], x, hot, 0.3)[0]) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("h", [{"solver": "adam", "learning_rate_init": "0.01"}, {"solver": "sgd", "learning_rate": "adaptive", "learning_rate_init": "0.01", "alpha": "0.01"}])
def test_network_learns(rows, h):
    data, info, z, y, on = data_of(rows.collect())
    got = L.LEARNERS["MLP"].predict([settle(L.LEARNERS["MLP"], data, info, h)], data, np.flatnonzero(on), h, info)
    assert (got == y[on]).mean() > 0.75


def test_draws_follow_poisson():
    key = np.random.default_rng(0).integers(0, 2**60, 200_000)
    n = T.draws(key, 3)
    for k in range(5):
        assert (n == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.005)
    assert not np.array_equal(n, T.draws(key, 4))


def test_quantile_bins_route_as_counted(spark):
    """More distinct values than bins: every cut parts the rows exactly as its histogram says."""
    rng = np.random.default_rng(1)
    rows = [(0, i, float(x), "ab"[int(x > 0.3) ^ int(rng.random() < 0.1)], int(rng.integers(5)), int(rng.integers(2**60))) for i, x in enumerate(rng.normal(size=3000))]
    d = spark.createDataFrame(rows, "dataset_id int, row_id int, u double, label string, fold int, key long")
    b = B.pack(d, ["dataset_id"], "label", ["u"], F.col("key"), None, block_rows=700)
    models = R.fit(b, R.tasks_of(d, ["dataset_id"], [{"config_id": 0, "algorithm": "DT", "hyperparameters": {"max_depth": "3"}}]), None)
    t = {r.place: r for r in B.model_table(models, ["dataset_id"], ["u"]).collect()}
    x = np.array([r[2] for r in rows])

    def check(place, some):
        assert t[place].value == len(some)
        if t[place].feature:
            check(2 * place, some[some <= t[place].cut])
            check(2 * place + 1, some[some > t[place].cut])

    check(1, x)
    assert abs(t[1].cut - 0.3) < 0.05


def test_neighbours_of_many_datasets(spark, rows):
    b = packed(spark, rows, block_rows=37)
    got = {(r.row_id, r.p, r.k): r._p for r in neighbours.confusion(b, [1, 4], [1, 2], ids=True).collect()}
    every = rows.collect()
    for d in range(3):
        part = [r for r in every if r.dataset_id == d]
        known = sorted({r.label for r in part})
        mean = np.mean([r.w for r in part if r.w is not None])
        x = np.array([[r.u, r.v, mean if r.w is None else r.w] for r in part])
        for i, r in enumerate(part):
            for p, k in ((1, 1), (2, 4), (1, 4)):
                gap = np.abs(x - x[i]).sum(1) if p == 1 else np.sqrt(((x - x[i]) ** 2).sum(1))
                near = sorted((gap[j], part[j].key, part[j].label) for j in range(len(part)) if part[j].fold != r.fold)[:k]
                votes = [n[2] for n in near]
                assert known[got[r.row_id, p, k]] == min(set(votes), key=lambda v: (-votes.count(v), v))


def test_new_rows_and_hostile_tables(spark, rows):
    train, new = rows.filter("fold < 4"), rows.filter("fold = 4").drop("fold")
    b = packed(spark, train.drop("fold").withColumn("fold", F.lit(0)))
    n = B.pack(new, ["dataset_id"], "label", ["u", "v", "w"], F.col("key"), None, ["row_id"], info=b.info)
    tasks = R.tasks_of(train, ["dataset_id"], [c for c in configs() if c["imputer"] == "mean"])
    out = R.apply(b, n, tasks)
    assert out.count() == new.count() * 5
    hit = out.filter("dataset_id = 0").groupBy("config_id").agg(F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("hit")).collect()
    assert all(r.hit > 0.55 for r in hit)
    odd = spark.createDataFrame([(0, 1, 1.0, None, "a", 0, 1), (0, 2, None, None, None, 1, 2), (0, 2, None, None, None, 1, 2), (1, 3, 2.0, None, "b", 0, 3), (2, 4, math.nan, None, None, 0, 4)], "dataset_id int, row_id int, u double, v double, label string, fold int, key long")
    for table in (odd, odd.limit(0)):
        b = B.pack(table, ["dataset_id"], "label", ["u", "v"], F.col("key"), 5, ["row_id"])
        perf = R.performance(b, R.tasks_of(odd, ["dataset_id"], [{"config_id": i, "algorithm": a, "hyperparameters": {}} for i, a in enumerate(("DT", "Logit", "KNN", "nothing"))])).collect()
        assert len(perf) == 12 and {r.status for r in perf if r.config_id == 3} == {"unknown"}


def test_finished_tasks_are_left_out(spark, rows):
    b = packed(spark, rows)
    tasks = R.tasks_of(rows, ["dataset_id"], [{"config_id": i, "algorithm": "GNB", "hyperparameters": {}} for i in range(2)])
    done = R.performance(b, tasks.filter("config_id = 0"))
    assert {r.config_id for r in R.performance(b, tasks, done=done).collect()} == {1}


def test_grid_names_every_algorithm():
    got = G.grid_configs()
    assert {c["algorithm"] for c in got} == set(ESTIMATORS) == set(R.ALGORITHMS) and all(settings(ESTIMATORS)[c["config_id"]]["hyperparameters"] == c["hyperparameters"] for c in got)


def test_blocks_deal_folds_by_rank(spark):
    """Ranks inside the blocks are those of the whole table, with repeated hashes, ties and missing values."""
    rng = np.random.default_rng(9)
    out = [(i % 3, int(rng.integers(400)), float(rng.integers(4)) if i % 11 else None, float(rng.normal()) if i % 7 else None, "ab"[int(rng.integers(2))] if i % 13 else None) for i in range(900)]
    rows = spark.createDataFrame([*out, (None, 1, 1.0, 1.0, "a"), (7, 1, 1.0, 1.0, None)], "dataset_id int, id int, u double, v double, label string").withColumn("rk", F.md5(F.col("id").cast("string")))
    key = F.conv(F.substring("rk", 1, 15), 16, 10).cast("long")
    want = stratified_folds(rows, "dataset_id", "label", "rk", ["u", "v"]).select("dataset_id", key.alias("key"), "u", "v", "label", "fold").collect()
    b = B.pack_folded(rows, ["dataset_id"], "label", ["u", "v"], "rk", ["u", "v"], block_rows=60)
    names, got = {r.dataset_id: r.classes for r in b.info.collect()}, []
    for r in b.frame.collect():
        data = B.Data(r.asDict(), 2)
        assert (np.diff(data.key) >= 0).all()
        got += [(r.dataset_id, int(k), *(None if math.isnan(v) else float(v) for v in x), names[r.dataset_id][y], int(f)) for k, x, y, f in zip(data.key, data.x, data.y, data.fold)]
    order = lambda t: sorted(map(tuple, t), key=str)
    assert b.frame.count() > 12 and order(got) == order(want)
    plain = B.pack(stratified_folds(rows, "dataset_id", "label", "rk", ["u", "v"]), ["dataset_id"], "label", ["u", "v"], key, block_rows=60)
    info = [{(r.dataset_id, r.outer): r for r in t.info.collect()} for t in (b, plain)]
    assert info[0].keys() == info[1].keys() and len(info[0]) == 18
    for at, r in info[0].items():
        assert r.counts == info[1][at].counts and len(r.edges) == 2
        assert r.fill == pytest.approx(info[1][at].fill) and r.sd == pytest.approx(info[1][at].sd)


def test_bins_are_counted_once_and_last_leaves_need_no_round():
    """Folds share the bins of rows without missing values; a tree of depth three takes three passes."""
    rng = np.random.default_rng(2)
    x, y, fold = rng.integers(0, 9, (500, 2)).astype(float), rng.integers(0, 2, 500).astype(np.int32), rng.integers(0, 5, 500).astype(np.int8)
    data = B.Data({"x": x.tobytes(), "y": y.tobytes(), "fold": fold.tobytes(), "key": np.arange(500).tobytes()}, 2)
    infos = [{"outer": o, "imputer": "mean", "standardize": True, "classes": ["a", "b"], "counts": np.bincount(y[fold != o]).tolist(), "fill": [4.0 + o, 4.0], "shift": [0.0, 0.0], "sd": [1.0, 1.0], "edges": [[float(v) for v in range(9)]] * 2} for o in range(5)]
    assert data.filled(infos[0]) is data.x and data.codes(infos[0]) is data.codes(infos[1])
    for name in ("DT", "RF", "ExtraTrees"):
        learner, h, passes = L.LEARNERS[name], {"max_depth": "3"}, 0
        state = learner.start(h, infos[0], 0)
        while not state.get("done"):
            state, passes = learner.update(state, learner.partial(state, data, h, infos[0]), h, infos[0]), passes + 1
        data.forget()
        tree, weight = state["tree"], (T.draws(data.key, 0) if name == "RF" else np.ones(500)) * (fold != 0)
        node = tree.route(x)
        assert passes == 3 and max(tree.depth) == 3
        for i in np.flatnonzero(np.array(tree.feature) == -1):
            assert tree.sums[i].tolist() == np.bincount(y, weights=weight * (node == i), minlength=2).tolist()
