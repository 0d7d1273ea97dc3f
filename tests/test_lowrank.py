from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from perfgrid.operators import cost as K
from perfgrid.operators import design as D
from perfgrid.operators import lowrank as L
from perfgrid.operators import tucker as T


def planted(n=200, m=40):
    i, j = np.meshgrid(np.arange(n), np.arange(m), indexing="ij")
    a = (1 + i % 7) * (1 + j % 5) + 4.0 * (i % 3 - 1) * (j % 4 - 1.5)
    hole = (i * 7919 + j * 104729 + i * j * 31) % 97 < 29
    return a, hole


def table(spark, a, keep=None):
    rows = [(int(i), int(j), float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1]) if keep is None or keep[i, j]]
    return spark.createDataFrame(rows, "dataset_id int, config_id int, error double")


def test_factors_match_numpy(spark):
    a, _ = planted(30, 12)
    a = a + np.random.default_rng(0).normal(size=a.shape)
    f = L.factorize(table(spark, a), "dataset_id", "config_id", "error", rank=4)
    assert np.allclose(f.sigma, np.linalg.svd(a, compute_uv=False)[:4])
    y = np.array([r["y"] for r in f.cols.orderBy("config_id").collect()])
    x = np.array([r["x"] for r in f.rows.orderBy("dataset_id").collect()])
    assert np.allclose(y.T @ y, np.eye(4), atol=1e-6)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(x @ y.T, (u[:, :4] * s[:4]) @ vt[:4], atol=1e-6)


def test_range_finder_matches_numpy(spark):
    a, _ = planted(60, 30)
    f = L._range_finder(table(spark, a), "dataset_id", "config_id", "error", 2, extra=2, sweeps=2)
    assert np.allclose(f.sigma, np.linalg.svd(a, compute_uv=False)[:2], rtol=1e-6)


def test_planted_rows_are_recovered(spark):
    a, hole = planted()
    f = L.factorize(table(spark, a[:100]), "dataset_id", "config_id", "error", rank=2)
    got = L.complete_rows(table(spark, a, ~hole), f.cols, 2).collect()
    assert max(abs(r["predicted"] - a[r["dataset_id"], r["config_id"]]) for r in got) < 1e-6 * np.abs(a).max()


def test_few_known_cells_give_minimum_norm(spark):
    a, _ = planted(20, 10)
    f = L.factorize(table(spark, a + np.eye(20, 10)), "dataset_id", "config_id", "error", rank=3)
    y = np.array([r["y"] for r in f.cols.orderBy("config_id").collect()])
    one = spark.createDataFrame([(1, 4, 2.0)], "dataset_id int, config_id int, error double")
    x = L.row_coefficients(one, f.cols, 3).first()["x"]
    assert np.allclose(x, np.linalg.lstsq(y[[4]], np.array([2.0]), rcond=None)[0], atol=1e-8)


def test_pivots_match_greedy_qr(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(15, 8))
    left, expect = a.copy(), []
    for _ in range(4):
        p = int(np.argmax((left**2).sum(0)))
        expect.append(p)
        q = left[:, p] / np.linalg.norm(left[:, p])
        left = left - np.outer(q, q @ left)
    got = L.pivot_columns(table(spark, a), "dataset_id", "config_id", "error", rank=4)
    assert [r["config_id"] for r in got.orderBy("place").collect()] == expect
    y = spark.createDataFrame([(j, a[:, j].tolist()) for j in range(8)], "config_id int, y array<double>")
    assert [r["config_id"] for r in L.pivot_latent(y, 4).orderBy("place").collect()] == expect


def coo(spark, t, keep=None):
    rows = [(*map(int, i), float(t[i])) for i in np.ndindex(*t.shape) if keep is None or keep[i]]
    return spark.createDataFrame(rows, ", ".join(f"i{m} int" for m in range(t.ndim)) + ", value double")


def low_rank_tensor(shape, r, seed=0):
    rng = np.random.default_rng(seed)
    t = rng.normal(size=[r] * len(shape))
    for m, n in enumerate(shape):
        t = np.moveaxis(np.tensordot(rng.normal(size=(n, r)), t, axes=(1, m)), 0, m)
    return t


def test_tucker_recovers_exact_rank(spark):
    t = low_rank_tensor((6, 5, 4), 2)
    m = T.decompose(coo(spark, t), [6, 5, 4], [2, 2, 2], sweeps=1)
    assert np.allclose(m.dense(), t, atol=1e-6)


def test_sweep_equals_dense_contraction(spark):
    """The sweep over observed cells only equals a sweep over the filled tensor."""
    t = low_rank_tensor((6, 5, 4), 3, 1)
    keep = np.random.default_rng(0).random(t.shape) < 0.7
    start = T.decompose(coo(spark, t, keep), [6, 5, 4], [2, 2, 2], sweeps=1)
    filled = np.where(keep, t, start.dense())
    a = T.sweep(coo(spark, t, keep), [6, 5, 4], [2, 2, 2], start.factors, start)
    b = T.sweep(coo(spark, filled), [6, 5, 4], [2, 2, 2], start.factors, None)
    assert np.allclose(a.dense(), b.dense(), atol=1e-8)


def test_completion_fits_observed_and_fills_holes(spark):
    t = low_rank_tensor((8, 6, 4), 1, 2)
    keep = np.random.default_rng(1).random(t.shape) < 0.8
    c = coo(spark, t, keep)
    m = T.complete(c, [8, 6, 4], [1, 1, 1], max_sweeps=12)
    assert all(b <= a + 1e-9 for a, b in zip(m.errors, m.errors[1:]))
    gap = np.linalg.norm((m.dense() - t)[~keep]) / np.linalg.norm(t[~keep])
    assert gap < 0.05
    full = T.fill(c, [8, 6, 4], m)
    assert full.count() == t.size
    assert all(abs(r["value"] - t[r["i0"], r["i1"], r["i2"]]) < 1e-12 for r in full.filter("observed").collect())


def test_latent_configs_match_svd(spark):
    t = low_rank_tensor((7, 4, 3), 2, 3)
    m = T.decompose(coo(spark, t), [7, 4, 3], [2, 2, 2], sweeps=1)
    s, cols = T.latent_configs(spark, m, [7, 4, 3], 2)
    u, sv, vt = np.linalg.svd(t.reshape(7, -1), full_matrices=False)
    y = np.array([r["y"] for r in cols.orderBy("config_id").collect()]).T
    assert np.allclose(s, sv[:2]) and np.allclose(np.abs(y @ vt[:2].T), np.eye(2), atol=1e-5)


def test_design_respects_budget_and_falls_back(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=(3, 20))
    t = rng.uniform(1, 3, 20)
    picks, case = D.start_set(y, t, 30.0, 3)
    assert case == "pivot" and len(set(picks)) == 3
    more = D.extend_d_optimal(y, t, picks, 30.0)
    assert more[:3] == picks and t[more].sum() <= 30.0 and len(set(more)) == len(more)
    rest = [i for i in range(20) if i not in more]
    assert t[more].sum() + t[rest].min() > 30.0
    picks, case = D.start_set(y, t, 4.0, 3)
    assert case == "cheapest" and t[picks].sum() <= 4.0


def test_costs_of_failed_runs_only_grow(spark):
    costs = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, 5.0)], "dataset_id int, config_id int, runtime double")
    seen = spark.createDataFrame([(1, 1, 2.0, "ok"), (1, 2, 2.0, "timeout"), (1, 3, 9.0, "timeout")], "dataset_id int, config_id int, runtime double, status string")
    got = {r["config_id"]: r["runtime"] for r in K.raise_cost(costs, seen).collect()}
    assert got == {1: 2.0, 2: 5.0, 3: 9.0}


def test_poly_cost_recovers_polynomial(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(n), int(d)) for i, (n, d) in enumerate(zip(rng.integers(150, 9000, 60), rng.integers(2, 300, 60)))]
    runs = spark.createDataFrame(rows, "dataset_id int, n_rows bigint, n_features bigint").withColumn("config_id", F.lit(1))
    runs = runs.withColumn("runtime", F.exp(0.2 * F.log("n_rows") + 1e-3 * F.col("n_features")))
    got = K.predict_poly(K.fit_poly(runs), runs).withColumnRenamed("runtime", "g").join(runs, ["dataset_id", "config_id"])
    worst = got.agg(F.max(F.abs(F.log("g") - F.log("runtime")))).first()[0]
    assert worst < 0.02


def test_rank_needs_one_bound(spark):
    with pytest.raises(ValueError):
        L.factorize(table(spark, planted(3, 3)[0]), "dataset_id", "config_id", "error")


def test_cells_at_full_ranks_take_bounded_memory():
    """A product of cells and factors is as wide as the core; it is taken for as many cells as fit."""
    import tracemalloc

    import pandas as pd

    sizes = [25, 25, 6, 3, 2]
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({f"i{m}": rng.integers(0, n, 3000) for m, n in enumerate(sizes)} | {"value": rng.normal(size=3000)})
    eyes = [np.eye(n) for n in sizes]
    total = [np.zeros((1, int(np.prod(sizes))))]
    tracemalloc.start()
    T._add_cells(total, pdf, [None], eyes, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20
    dense = np.zeros(sizes)
    np.add.at(dense, tuple(pdf[f"i{m}"] for m in range(5)), pdf["value"])
    assert np.allclose(total[0][0], dense.ravel())
