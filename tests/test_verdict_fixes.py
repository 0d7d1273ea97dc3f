"""Penalties, boosting without loss of datasets, merging in any order, neighbours in chunks."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from perfgrid.operators import boost, cost, mllib, prep
from perfgrid.sources import tables as X


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [5, 0.1, 1]
    y = x @ [2.0, 900.0, -3.0] + rng.normal(size=300) * 50
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, label double")
    return x, y, VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def test_ridge_equals_normal_equations(line):
    x, y, df = line
    xc = x - x.mean(0)
    for alpha in (0.1, 10.0):
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ (y - y.mean()))
        got = mllib.regressor("Ridge", alpha, len(y), float(y.std())).fit(df).coefficients.toArray()
        assert got == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize("algorithm,share", [("Lasso", 1.0), ("ElasticNet", 0.5)])
def test_penalized_optimum(line, algorithm, share):
    x, y, df = line
    alpha = 2.0
    w = mllib.regressor(algorithm, alpha, len(y), float(y.std()), share).fit(df).coefficients.toArray()
    xc, yc = x - x.mean(0), y - y.mean()
    pull = xc.T @ (yc - xc @ w) / len(y) - alpha * (1 - share) * w
    for p, v in zip(pull, w):
        assert abs(p) <= alpha * share + 1e-3 if v == 0 else p == pytest.approx(np.sign(v) * alpha * share, abs=1e-3)


def test_logistic_penalty_is_on_raw_coefficients(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2)) * [10, 0.2]
    y = (x @ [0.1, 6.0] + rng.logistic(size=400) > 0).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, label double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    m = mllib.learner("Logit", {"C": "0.5", "penalty": "l2"}, 400, 2, 2).fit(df)
    w, b = m.coefficients.toArray(), m.intercept
    grad = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) + w / 0.5
    assert np.abs(grad).max() < 0.05


def test_boosting_keeps_every_dataset(spark):
    rows = [(0, i, float(i), "a" if i < 6 else "b") for i in range(12)]  # separable
    rows += [(1, i, float(i), "only") for i in range(5)]  # one class
    rows += [(2, i, 1.0, "xy"[i % 2]) for i in range(5)]  # no split
    df = spark.createDataFrame(rows, "dataset_id int, row_id int, v double, label string")
    s = boost.adaboost(df, ["dataset_id"], "label", ["v"], 4)
    got = boost.predict(df, s, ["dataset_id"], ["v"]).collect()
    assert len(got) == len(rows)
    said = {(r.dataset_id, r.row_id): r.prediction for r in got}
    assert all(said[0, i] == ("a" if i < 6 else "b") for i in range(12))
    assert {said[1, i] for i in range(5)} == {"only"} and {said[2, i] for i in range(5)} == {"x"}


def test_boosting_weights_do_not_overflow(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, float(v), "pqr"[int(rng.integers(3))]) for i, v in enumerate(rng.normal(size=60))]
    df = spark.createDataFrame(rows, "dataset_id int, row_id int, v double, label string")
    s = boost.adaboost(df, ["dataset_id"], "label", ["v"], 6, rate=400.0)
    assert all(np.isfinite(t.error) for r in s.collect() for t in r.stumps)


def test_merge_does_not_depend_on_arrival(spark):
    cells = lambda i, heads, e=0.5: [(str(i), h, e, 1.0) for h in heads]
    files = {1: cells(1, "pq"), 2: cells(2, "pq"), 3: cells(3, "pqs"), 4: cells(4, "p"), 5: cells(5, "pq") + cells(5, "pq", 0.7), 6: cells(6, "pq") * 2, 7: cells(7, "pq", None)}
    frame = lambda ids: spark.createDataFrame([r for i in ids for r in files[i]], X.RESULT)
    heads, none = spark.createDataFrame([("p",), ("q",)], "config string"), spark.createDataFrame([], X.RESULT)
    together = X.merge_rows(none, frame(files), heads)
    apart = none
    for i in (3, 7, 2, 5, 1, 6, 4):
        apart = X.merge_rows(apart, frame([i]), heads)
    ids = lambda t: sorted(tuple(r) for r in t.collect())
    assert ids(together) == ids(apart) and {r[0] for r in ids(together)} == {"1", "2", "6"}
    status = {r.dataset_id: r.status for r in X.merge_status(none, frame(files), heads).collect()}
    assert status == {"1": "new", "2": "new", "3": "headings", "4": "headings", "5": "conflict", "6": "new", "7": "missing"}


def test_cost_neighbours_in_chunks(spark):
    rng = np.random.default_rng(5)
    runs = spark.createDataFrame([(c, i, int(rng.integers(10, 900)), int(rng.integers(2, 40)), float(rng.uniform(1, 9))) for c in (1, 2) for i in range(40)], "config_id int, dataset_id int, n_rows long, n_features long, runtime double")
    new = spark.createDataFrame([(100, 50, 5), (101, 700, 30)], "dataset_id int, n_rows long, n_features long")
    rows = lambda t: sorted((r.dataset_id, r.config_id, round(r.runtime, 9)) for r in t.collect())
    assert rows(cost.knn_cost(runs, new)) == rows(cost.knn_cost(runs, new, chunk=7))


def test_one_hot_index(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"v{i % 30:02d}") for i in range(200)], "i int, s string")
    found = sorted({r.s for r in df.collect() if r.s})
    for r in prep.one_hot_index(df, "s").collect():
        assert r.s_index == (None if r.s is None else found.index(r.s))
    assert df.filter(F.col("s").isNull()).count() > 0
