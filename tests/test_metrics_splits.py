from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perfgrid.functions import metrics as M
from perfgrid.functions.scalars import hash_order, int_text, percent
from perfgrid.operators import ranking as R
from perfgrid.operators import splits as P

RELAXED = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def brute_ber(y, p):
    out = []
    for c in sorted(set(y)):
        tp = sum(a == c and b == c for a, b in zip(y, p))
        tn = sum(a != c and b != c for a, b in zip(y, p))
        fp = sum(a != c and b == c for a, b in zip(y, p))
        fn = sum(a == c and b != c for a, b in zip(y, p))
        out.append(1 - 0.5 * tp / max(tp + fn, 1e-15) - 0.5 * tn / max(tn + fp, 1e-15))
    return float(np.mean(out))


@pytest.mark.parametrize(
    "y,p,expected",
    [("aabb", "aabb", 0.0), ("aabb", "bbaa", 1.0), ("aabb", "aaab", 0.25), ("aaaa", "aaaa", 0.5), ("aabb", "accb", 0.25)],
)
def test_ber_by_hand(spark, y, p, expected):
    df = spark.createDataFrame([(0, a, b) for a, b in zip(y, p)], "k int, label string, prediction string")
    assert M.ber(df, ["k"]).first()["ber"] == pytest.approx(expected)
    assert brute_ber(y, p) == pytest.approx(expected)


@RELAXED
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("abcd")), min_size=1, max_size=30))
def test_ber_equals_brute_force(spark, rows):
    df = spark.createDataFrame([(0, a, b) for a, b in rows], "k int, label string, prediction string")
    assert M.ber(df, ["k"]).first()["ber"] == pytest.approx(brute_ber([a for a, _ in rows], [b for _, b in rows]))


def _rows(spark, n, classes=3):
    d = spark.range(n).withColumn("dataset_id", (F.col("id") % 7 == 0).cast("int")).withColumn("label", F.col("id") % classes)
    return d.withColumn("rk", hash_order(1, "id"))


def test_hash_rank_is_row_number(spark):
    d = _rows(spark, 2000)
    a = {r["id"]: r["rank"] for r in R.hash_rank(d, ["dataset_id"], "rk").collect()}
    groups: dict = {}
    for r in sorted(d.collect(), key=lambda r: r["rk"]):
        groups.setdefault(r["dataset_id"], []).append(r["id"])
    assert a == {i: pos + 1 for ids in groups.values() for pos, i in enumerate(ids)}


def test_folds_partition_and_balance(spark):
    d = P.stratified_folds(_rows(spark, 1003), "dataset_id", "label", "rk")
    counts = d.groupBy("dataset_id", "label", "fold").count().collect()
    assert sum(r["count"] for r in counts) == 1003
    per: dict = {}
    for r in counts:
        per.setdefault((r["dataset_id"], r["label"]), []).append(r["count"])
    assert all(len(v) == 5 and max(v) - min(v) <= 1 for v in per.values())


def test_plain_folds_for_regression(spark):
    d = P.stratified_folds(_rows(spark, 100, 100), "dataset_id", "label", "rk", stratify=False)
    sizes = [r["count"] for r in d.groupBy("dataset_id", "fold").count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 100


def test_holdout_falls_back_without_strata(spark):
    rows = [(0, i, "a" if i else "b") for i in range(20)]
    d = spark.createDataFrame(rows, "dataset_id int, id int, label string").withColumn("rk", hash_order(0, "id"))
    parts = {r["part"]: r["count"] for r in P.holdout(d, ["dataset_id"], "label", "rk").groupBy("part").count().collect()}
    assert parts == {"train": 17, "test": 3}


def test_holdout_quota_sums_to_share(spark):
    d = P.holdout(_rows(spark, 1001), ["dataset_id"], "label", "rk")
    got = {(r["dataset_id"], r["part"]): r["count"] for r in d.groupBy("dataset_id", "part").count().collect()}
    for k in (0, 1):
        n = got[(k, "train")] + got[(k, "test")]
        assert got[(k, "test")] == int(np.ceil(0.15 * n))


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.99, 1.0])
def test_grouped_quantile_is_exact(spark, q):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 2, 3001), np.round(rng.normal(size=3001), 2))]
    df = spark.createDataFrame(rows, "g int, v double")
    for r in R.grouped_quantile(df, ["g"], "v", q, accuracy=100).collect():
        assert r["quantile"] == pytest.approx(np.quantile([v for g, v in rows if g == r["g"]], q))


def test_prefix_sums_over_one_hot_group(spark):
    d = spark.range(5000).select(F.lit(1).alias("g"), F.col("id").alias("o"), (F.col("id") % 3).cast("double").alias("v"))
    got = [r["v_upto"] for r in R.prefix_sums(d, ["g"], ["o"], ["v"]).orderBy("o").collect()]
    assert got == list(np.cumsum(np.arange(5000) % 3))


def test_mode_ties_to_smallest(spark):
    df = spark.createDataFrame([(0, "b"), (0, "a"), (0, None)], "g int, v string")
    assert R.grouped_mode(df, ["g"], "v").first()["mode"] == "a"


def test_scalar_forms(spark):
    df = spark.createDataFrame([("25%", 2.0), ("75%", 0.001)], "p string, v double")
    rows = df.select(percent("p").alias("p"), int_text("v").alias("t")).collect()
    assert [r["p"] for r in rows] == [0.25, 0.75] and rows[0]["t"] == "2" and float(rows[1]["t"]) == 0.001


def test_many_small_groups_are_ranked_whole(spark):
    """No sub-ranges, as many as rows, are joined to them; null groups have no rank, as before."""
    d = spark.range(6000).select(F.when(F.col("id") % 600 != 5, F.col("id") % 600).alias("g"), "id", F.md5(F.col("id").cast("string")).alias("rk"))
    ranked = R.hash_rank(d, ["g"], "rk", size="n")
    assert "Join" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    got: dict = {}
    for r in ranked.orderBy("g", "rk").collect():
        got.setdefault(r.g, []).append((r["rank"], r.n))
    assert len(got) == 599 and all(v == [(i + 1, 10) for i in range(10)] for v in got.values())


def test_nested_split_equals_a_split_of_each_training_set(spark):
    """Ranks among the training rows follow from one ranking; a class too small for it is drawn from all classes."""
    rows = [(g, f"{g}-{i}", "ab"[i % 7 > 4] if i or g else "c", f"{(i * 7919 + g) % 10007:08x}") for g in (0, 1) for i in range(211)]
    df = spark.createDataFrame(rows, "dataset_id int, row_id string, label string, rk string")
    got = {(r.row_id, r.outer): r.part for r in P.nested_split(df, "dataset_id", "label", "rk").collect()}
    folds = P.stratified_folds(df, "dataset_id", "label", "rk")
    for o in range(5):
        want = {r.row_id: "valid" if r.part == "test" else r.part for r in P.holdout(folds.filter(F.col("fold") != o), ["dataset_id"], "label", "rk").collect()}
        want |= {r.row_id: "test" for r in folds.filter(F.col("fold") == o).collect()}
        assert {k: v for (k, i), v in got.items() if i == o} == want
    easy = P.nested_split(df.filter("dataset_id = 1"), "dataset_id", "label", "rk")
    assert easy._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 1  # rows are sorted once for all folds
