"""Datasets of a few blocks train without rounds, and rows are scored by all configurations without being exploded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perfgrid.operators import blocks as B
from perfgrid.operators import cv, gnb
from perfgrid.operators import runner as R
from perfgrid.operators.ranking import left_out_medians

LEARNERS = {
    "DT": {"min_samples_split": "8", "max_depth": "4"}, "RF": {"n_estimators": "2", "min_samples_split": "8"}, "GBT": {"n_estimators": "2", "max_depth": "2"},
    "AB": {"n_estimators": "3"}, "Logit": {"C": "1"}, "lSVM": {"C": "0.5"},
}


def rows_of(spark, n=300):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        x = [float(rng.integers(0, 12)), float(rng.integers(0, 5)), None if rng.random() < 0.1 else round(float(rng.normal()), 1)]
        y = None if rng.random() < 0.03 else "abc"[min(2, int(x[0] + 2 * rng.random()) // 5)]
        out.append((i % 2, *x, y, int(rng.integers(5)), int(rng.integers(2**60))))
    return spark.createDataFrame(out, "dataset_id int, u double, v double, w double, label string, fold int, key long")


def test_few_blocks_need_no_rounds(spark, monkeypatch):
    configs = [{"config_id": i, "algorithm": a, "hyperparameters": h} for i, (a, h) in enumerate(LEARNERS.items())]
    b = B.pack(rows_of(spark), ["dataset_id"], "label", ["u", "v", "w"], F.col("key"), None, block_rows=40)
    tasks = R.tasks_of(b.info, ["dataset_id"], configs)

    def table():
        t = B.model_table(R.fit(b, tasks, None), ["dataset_id"], b.cols).collect()
        return {tuple(r)[:-2]: tuple(r)[-2:] for r in t}

    met = []
    real = B._meet
    monkeypatch.setattr(B, "_meet", lambda *a, **kw: met.append(1) or real(*a, **kw))
    whole = table()
    assert not met
    monkeypatch.setattr(B, "WHOLE_BYTES", 0)
    rounds = table()
    assert met and whole.keys() == rounds.keys() and len(whole) > 50
    for k, pair in whole.items():
        for a, c in zip(pair, rounds[k]):
            assert (a is None) == (c is None) and (a is None or a == pytest.approx(c, abs=1e-7))


def test_configs_do_not_multiply_rows(spark, monkeypatch):
    rows, cols = rows_of(spark), ["u", "v", "w"]
    args = (rows, ["dataset_id"], "label", cols, cv.FAMILY)
    counted = lambda: {tuple(r)[:-1]: r["_n"] for r in cv.cv_counts(*args).collect()}
    monkeypatch.setattr(gnb, "COUNT_BYTES", 0)
    joined = counted()
    monkeypatch.setattr(gnb, "COUNT_BYTES", 32 << 20)
    monkeypatch.setattr(gnb, "COUNT_ROWS", 16)
    monkeypatch.setattr(gnb, "predict", lambda *a, **kw: pytest.fail("rows were joined with every model"))
    # a quarter of three features is none: these eight configurations have no model
    assert counted() == joined and sum(joined.values()) == 300 * (len(cv.FAMILY) - 8)


def test_medians_without_repeated_rows(spark):
    rng = np.random.default_rng(8)
    data = [(i % 3, int(rng.integers(4)), None if rng.random() < 0.2 else float(rng.integers(-4, 4)), float(rng.normal()) if i % 3 else None) for i in range(400)]
    rows = spark.createDataFrame(data, "g int, fold int, u double, v double")
    got = {(r.g, r.outer, r.feature): r.m for r in left_out_medians(rows, ["g"], ["u", "v"], 4, "m", accuracy=50, width=1).collect()}
    want = {}
    for g in range(3):
        for o in range(4):
            for j, c in enumerate("uv"):
                x = [r[2 + j] for r in data if r[0] == g and r[1] != o and r[2 + j] is not None]
                if x:
                    want[g, o, c] = float(np.median(x))
    assert got == pytest.approx(want)
