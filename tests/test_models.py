from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from perfgrid.operators import cv, ensemble, gnb, knn, linear
from perfgrid.operators import select as S
from perfgrid.sources import grids as G
from perfgrid.sources import tables as X


def test_grid_sizes_and_order(spark):
    assert len(G.settings(G.ESTIMATORS)) == 183
    assert G.step_sizes() == [4, 2, 2, 8, 183]
    t = G.search_space(spark.createDataFrame([(1,)], "dataset_id int")).filter("config_id = 12345").first()
    idx = 12345
    expect = []
    for n in [183, 8, 2, 2, 4]:
        expect.append(idx % n)
        idx //= n
    assert [t[f"{s}_id"] for s in ["estimator", "dim_reducer", "standardizer", "encoder", "imputer"]] == expect


def test_read_grid_keeps_null_and_text(spark, tmp_path):
    path = tmp_path / "grid.json"
    path.write_text('{"algorithms": ["A", null],\n "hyperparameters": {"A": {"x": [1, 0.5], "y": [null, "z"]}}}')
    grid = G.read_grid(spark, str(path))
    assert grid == {"A": {"x": ["1", "0.5"], "y": [None, "z"]}, None: {}}
    assert len(G.settings(grid)) == 5


def test_hyperparameter_filter_filters(spark):
    """The filter looks at hyperparameter values, not at the algorithm's name."""
    rows = [("KNN", {"k": "1"}), ("KNN", {"k": "3"}), ("DT", {"s": "2"}), ("NB", {})]
    df = spark.createDataFrame(rows, "algorithm string, hyperparameters map<string,string>")
    got = S.filter_configs(df, ["KNN", "NB"], {"KNN": {"k": ["3"]}}).collect()
    assert [(r["algorithm"], r["hyperparameters"]) for r in got] == [("KNN", {"k": "3"}), ("NB", {})]
    with pytest.raises(ValueError):
        S.filter_configs(df)


def test_failed_runs_are_not_good_errors(spark):
    df = spark.createDataFrame([(1, 1, -1.0, "timeout"), (1, 2, 0.3, "ok")], "dataset_id int, config_id int, error double, status string")
    best = ensemble.best_several(S.valid_errors(df), 2, "config_id").collect()
    assert [r["config_id"] for r in best] == [2]


def test_budget_pick_skips_but_goes_on(spark):
    df = spark.createDataFrame([(1, i, float(i), c) for i, c in enumerate([5.0, 9.0, 4.0, 2.0])], "dataset_id int, config_id int, e double, cost double")
    got = S.budget_pick(df, F.lit(10.0), ["e"]).orderBy("place").collect()
    assert [(r["config_id"], r["spent"]) for r in got] == [(0, 5.0), (2, 9.0)]


def _blobs(spark, n=300, d=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, d)) + y[:, None] * 1.5
    rows = [(int(i % 2), int(i), int(i % 5), int(c), *[float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x))]
    cols = [f"f{j}" for j in range(d)]
    return spark.createDataFrame(rows, "dataset_id int, row_id int, fold int, label int, " + ", ".join(f"{c} double" for c in cols)), rows, cols


def test_gnb_equals_direct_fit(spark):
    df, rows, cols = _blobs(spark)
    model = gnb.fit(df, ["dataset_id"], "label", cols)
    got = {r["row_id"]: r["prediction"] for r in gnb.predict(df, model, ["dataset_id"], cols).collect()}
    for r in rows[:60]:
        train = np.array([t for t in rows if t[0] == r[0] and t[2] != r[2]])
        x, y = train[:, 4:], train[:, 3]
        eps = 1e-9 * x.var(0).max()
        best = []
        for c in np.unique(y):
            xc = x[y == c]
            v = xc.var(0) + eps
            best.append(np.log(len(xc) / len(x)) - 0.5 * np.log(2 * np.pi * v).sum() - 0.5 * ((np.array(r[4:]) - xc.mean(0)) ** 2 / v).sum())
        assert got[r[1]] == int(np.unique(y)[int(np.argmax(best))])


def test_knn_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 4)) * 0.05 + i for i in (0, 4)])  # two tight clouds: pruning has work to do
    rows = [(i, [float(v) for v in r], int(i % 3), int(i % 5)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id bigint, x array<double>, label int, fold int")
    for p in (1, 2):
        got: dict = {}
        for r in knn.neighbours(df, 5, p, block=16).collect():
            got.setdefault(r["row_id"], []).append((r["place"], r["near_id"]))
        for i in range(0, len(x), 17):
            gap = np.abs(x - x[i]).sum(1) if p == 1 else np.sqrt(((x - x[i]) ** 2).sum(1))
            other = [j for j in range(len(x)) if rows[j][3] != rows[i][3]]
            expect = sorted(other, key=lambda j: (gap[j], j))[:5]
            assert [j for _, j in sorted(got[i])] == expect


def test_linear_learns(spark):
    df, _, cols = _blobs(spark)
    for loss in ("perceptron", "logistic", "squared_hinge"):
        s = linear.fit(df, ["dataset_id"], "label", cols, loss, epochs=4, penalty="l1")
        pred = linear.predict(df, s, ["dataset_id"], cols)
        assert pred.filter("prediction = label").count() / pred.count() > 0.5


def test_invalid_config_is_recorded(spark):
    df, _, _ = _blobs(spark, 60)
    df = df.withColumn("flat", F.lit(1.0)).withColumn("gone", F.lit(None).cast("double"))
    configs = [
        {"config_id": 0, "imputer": "mean", "scale": False, "reducer": None, "share": None},
        {"config_id": 1, "imputer": "mean", "scale": False, "reducer": "VarianceThreshold", "share": None},
    ]
    got = {(r["dataset_id"], r["config_id"]): r for r in cv.perf_table(df, ["dataset_id"], "label", ["flat", "gone"], configs).collect()}
    assert len(got) == 4
    assert got[(0, 0)]["status"] == "ok" and got[(0, 1)]["status"] == "invalid" and got[(0, 1)]["error"] is None


def test_greedy_stays_within_size_and_improves(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    rows = []
    for m in range(6):
        flip = rng.random(200) < 0.3 + 0.02 * m
        rows += [(1, i, m, int(c), int(c ^ f)) for i, (c, f) in enumerate(zip(y, flip))]
    pred = spark.createDataFrame(rows, "dataset_id int, row_id int, member int, label int, prediction int")
    for size in (3, 5):
        r = ensemble.greedy_select(pred, ["dataset_id", "row_id"], size).first()
        assert len(r["chosen"]) <= size
        first = ensemble.greedy_select(pred, ["dataset_id", "row_id"], 3).first()
        assert r["error"] <= first["error"] + 1e-12 and r["chosen"][:3] == first["chosen"]


def test_merge_aligns_headers_skips_incomplete_and_repeats(spark):
    text = [
        ("/x/00001.csv", ',"{""a"": 1, ""b"": 2}",q\nError,0.1,0.2\nTime,1,2'),
        ("/x/00002.csv", ',q,"{""a"": 1, ""b"": 2}"\nError,0.4,0.3\nTime,4,3'),
        ("/x/00003.csv", ',q,"{""a"": 1, ""b"": 2}"\nError,,0.3\nTime,4,3'),
    ]
    cells = X.parse_results(spark.createDataFrame(text, "path string, content string"))
    empty = spark.createDataFrame([], X.RESULT)
    once = X.merge_rows(empty, cells)
    twice = X.merge_rows(once, cells)
    got = {(r["dataset_id"], r["config"]): (r["error"], r["runtime"]) for r in twice.collect()}
    assert twice.count() == 4
    assert got[("00002", '{"a": 1, "b": 2}')] == (0.3, 3.0) and got[("00002", "q")] == (0.4, 4.0)


def test_load_labelled_csv(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "data_00042_x.csv").write_text("1.5,nan,a\n2.5,3.0,b\n")
    schema = T.StructType.fromDDL("f0 double, f1 double, y string")
    rows = X.load_labelled(spark, str(tmp_path), schema).orderBy("f0").collect()
    assert [r["dataset_id"] for r in rows] == [42, 42] and rows[0]["f1"] is None and [r["label"] for r in rows] == ["a", "b"]


def test_artefact_modes(spark, tmp_path):
    path = str(tmp_path / "t")
    one = lambda v: lambda: spark.createDataFrame([(v,)], "v int")
    assert X.artefact(spark, path, one(1)).first()["v"] == 1
    assert X.artefact(spark, path, one(2)).first()["v"] == 1
    assert X.artefact(spark, path, one(3), "fresh").first()["v"] == 3


def test_knn_moves_a_row_once_for_each_part(spark, monkeypatch):
    """A task keeps k neighbours of a query row; rows do not come once for each pair of blocks."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 3)), 1)  # no structure, many equal distances
    x[::90] = x[0]
    rows = [(i, [float(v) for v in r], int(i % 3), int(i % 5)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id bigint, x array<double>, label int, fold int")
    seen = []
    top = knn.top_k
    monkeypatch.setattr(knn, "top_k", lambda found, *a: seen.append(found.count()) or top(found, *a))
    got: dict = {}
    for r in knn.neighbours(df, 4, 1, block=16).collect():
        got.setdefault(r["row_id"], []).append((r["place"], r["near_id"]))
    parts = 4  # tasks of eight partitions: four parts a side
    assert seen[0] <= len(x) * 4 * parts
    for i in range(0, len(x), 37):
        gap = np.round(np.abs(x - x[i]).sum(1), 9)
        near = [j for _, j in sorted(got[i])]
        assert sorted(gap[near]) == sorted(gap[[j for j in range(len(x)) if j % 5 != i % 5]])[:4]


def test_nearest_in_many_dimensions_is_exact():
    """Products of matrices only bound the distances; with large offsets their own digits would not do."""
    rng = np.random.default_rng(6)
    a, b = (1000.0 + rng.normal(size=(n, 24)) for n in (40, 300))
    b[100] = b[7]
    found = knn.KNearest(a, 6, 2)
    for s in range(0, 300, 50):
        found.add(b[s : s + 50], np.arange(s, s + 50), np.arange(s, s + 50))
    for i in range(len(a)):
        gap = knn._paired(np.broadcast_to(a[i], b.shape), b, 2)
        assert found.at[i].tolist() == np.lexsort((np.arange(300), gap))[:6].tolist()
