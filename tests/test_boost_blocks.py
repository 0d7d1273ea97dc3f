"""Boosting reads its rows once for all rounds, and blocks in a feature's order find what counts of values find."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from perfgrid.operators import boost


def _rows(spark, n: int = 3000):
    draw = random.Random(5)
    rows = []
    for i in range(n):
        a = draw.choice([None, float("nan"), 7.0, 7.0, 7.0, round(draw.random() * 40, 1)])
        b = float(draw.randrange(5))
        label = "x" if (a or 0) > 12 else draw.choice("yz") if b > 2 else "y"
        rows.append((i % 3 if i % 7 else 0, label if i % 50 else None, a, b, draw.random()))
    return spark.createDataFrame(rows, "dataset_id int, label string, a double, b double, c double")


def test_rows_are_read_a_fixed_number_of_times(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    rows = _rows(spark).withColumn("a", F.udf(seen, "double")("a"))
    s = boost.adaboost(rows, ["dataset_id"], "label", ["a", "b", "c"], 4).collect()
    assert max(len(r.stumps) for r in s) > 2
    assert read.value <= 2 * 3000


def test_blocks_agree_with_counts_of_values(spark, monkeypatch):
    found = []
    for few in (0, 100_000):
        monkeypatch.setattr(boost, "FEW_VALUES", few)
        s = boost.adaboost(_rows(spark), ["dataset_id"], "label", ["a", "b", "c"], 3)
        found.append({r.dataset_id: [(t.feature, round(t.threshold, 9), t.low, t.high, round(t.alpha, 9)) for t in r.stumps] for r in s.collect()})
    assert len(found[0]) == 3 and repr(sorted(found[0].items())) == repr(sorted(found[1].items()))


def _brute(rows, n_rounds):
    """SAMME stumps over (label, values) rows without missing ones."""
    from math import exp, log

    names, m, out = sorted({r[0] for r in rows}), [0.0] * len(rows), []
    for _ in range(n_rounds):
        w, best = [exp(x - max(m)) for x in m], None
        for j, f in enumerate("abc"):
            values = sorted({r[1][j] for r in rows})
            for v, nxt in zip(values, values[1:]):
                sides = [[sum(x for x, r in zip(w, rows) if r[0] == c and (r[1][j] <= v) == low) for c in names] for low in (True, False)]
                gini = round(sum(sum(s) - sum(x * x for x in s) / sum(s) for s in sides) / sum(w), 12)
                leaf = [names[s.index(max(s))] for s in sides]
                pick = (gini, f, v, (v + nxt) / 2, *leaf, 1 - sum(max(s) for s in sides) / sum(w), j)
                best = pick if best is None else min(best, pick)
        _, f, _, cut, low, high, error, j = best
        say = log((1 - error) / max(error, 1e-12)) + log(len(names) - 1)
        if say <= 0 or error >= 1 - 1 / len(names):
            break
        out.append((f, round(cut, 9), low, high, round(say, 6)))
        m = [x + say * ((low if r[1][j] <= cut else high) != r[0]) for x, r in zip(m, rows)]
    return out


def test_stumps_are_those_of_brute_force(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(draw.choice("xyz") if i % 4 else "x", (draw.random(), float(draw.randrange(4)), float(draw.randrange(30)))) for i in range(200)]
    df = spark.createDataFrame([(1, y, *v) for y, v in rows], "dataset_id int, label string, a double, b double, c double")
    monkeypatch.setattr(boost, "FEW_VALUES", 8)
    got = boost.adaboost(df, ["dataset_id"], "label", ["a", "b", "c"], 3).first().stumps
    assert [(t.feature, round(t.threshold, 9), t.low, t.high, round(t.alpha, 6)) for t in got] == _brute(rows, 3)
