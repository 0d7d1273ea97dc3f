"""Nearest neighbours, hard negatives and conversation repair against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from perfgrid.llm import op11_hilbert_windows as curve
from perfgrid.llm import op12_multi_index_negatives as mine
from perfgrid.llm import op13_conversation_repair as conv
from perfgrid.llm.common import load

VECTORS = "vec_id long, embedding array<float>, label int"


def odd_rows(n=400, dim=8, seed=3):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)], int(rng.integers(3))) for i in range(1, n)]
    rows += [(1000 + i, [1.0] + [0.5] * (dim - 1), 1) for i in range(120)]  # a hot vector
    rows += [(2000, None, 1), (2020, [nan] * dim, 1), (2040, [inf] + [0.0] * (dim - 1), 1), (2060, [None] + [1.0] * (dim - 1), 1), (2080, [0.0] * dim, 1), (2100, [1.0, 2.0], None), (2120, [2.0, 1.0], 1), (2140, [], 1)]
    rows += [(100, [1.0] + [0.5] * (dim - 1), 1), (None, [1.0] * dim, 2), (100, [1.0] + [0.5] * (dim - 1), 1)]
    return rows


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_hilbert_order():
    for dims, bits in ((2, 4), (3, 3), (1, 6)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = curve.hilbert_keys(cells, bits)
        assert sorted(key) == list(range(len(cells)))  # each cell once
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()  # neighbours along the curve touch


def test_nearest(spark):
    rows = odd_rows()
    got = {}
    for r in curve.nearest(spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", score string"), F.col("vec_id") % 20 == 0, k=7, curves=6, block_rows=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    live = [r for r in rows if usable(r[1]) and any(r[1]) and r[0] is not None]
    hit = total = 0
    for at, q in enumerate(live):
        if q[0] % 20 == 0 and q[0] != 100:
            others = [(-float(np.dot(q[1], c[1])), c[0]) for i, c in enumerate(live) if i != at and len(c[1]) == len(q[1])]
            want, mine_ = sorted(others)[:7], sorted(got.get(q[0], []))
            assert [r for r, _, _ in mine_] == list(range(1, len(want) + 1))
            assert [(-s, i) for _, i, s in mine_] == sorted((-s, i) for _, i, s in mine_)
            exact = dict((i, s) for s, i in others)
            assert all(abs(exact[i] + s) < 1e-12 for _, i, s in mine_)
            hit, total = hit + len({i for _, i in want} & {i for _, i, _ in mine_}), total + len(want)
            if q[0] >= 1000 and len(q[1]) == 8:  # equal vectors: ties go to the smallest ids, all of them found
                assert [i for _, i, _ in mine_] == [i for _, i in want]
    assert hit >= 0.9 * total
    assert len(got[100]) == 21 and len(got[2120]) == 1  # rows given twice are queries of their own; 2100 is another of its length
    assert curve.nearest(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_and_windows(spark, folder):
    e = load(spark, f"/root/testdata/{folder}", "embeddings")
    report = {}
    got = curve.nearest(e, F.col("vec_id") % 20 == 0, report=report).toPandas()
    p = e.toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    hit = 0
    for q, part in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(part.vec_id) & set(ids[np.argsort(-s)[:20]]))
    assert hit >= 0.9 * len(got) and len(got) == 20 * (ids % 20 == 0).sum()
    assert report[64]["window"] < len(ids) / 4


def test_windows_shrink_with_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    rows = [(i, [float(v) for v in centres[i % 60] + rng.normal(size=16) * 0.05], 0) for i in range(6000)]
    report = {}
    got = curve.nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 200 == 0, k=10, report=report)
    assert got.filter("query_id % 60 = vec_id % 60").count() >= 0.95 * got.count()
    assert report[16]["window"] < 300


def negatives_of(rows, low=80, high=100):
    out = []
    live = [r for r in rows if usable(r[1]) and r[2] is not None and r[0] is not None]
    v = [[int(np.floor(256 * x)) for x in r[1]] for r in live]
    for a, anchor in enumerate(live):
        if anchor[0] % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v[a], v[c])), r[0], c) for c, r in enumerate(live) if c != a and len(v[c]) == len(v[a]))
        for s, i, c in [x for x in scored if live[x[2]][2] == anchor[2]][:5]:
            fit = [(t, j) for t, j, d in scored if live[d][2] != anchor[2] and low * -s <= 100 * -t <= high * -s]
            out += [(anchor[0], i, n + 1, j, -s, -t) for n, (t, j) in enumerate(fit[:5])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,first", [(16, 1), (4096, 64)])
def test_hard_negatives(spark, shard_rows, first):
    rows = odd_rows(260)
    df = spark.createDataFrame([(*r, 5) for r in rows], VECTORS + ", score int").filter(mine.finite("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    v = df.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))
    got = sorted(map(tuple, mine.hard_negatives(v, F.col("vec_id") % 10 == 0, shard_rows=shard_rows, first=first).collect()))
    assert got == negatives_of(rows)
    assert mine.hard_negatives(v.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_walk_falls_and_is_whole():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 5), (6, 2)):
        a, b = rng.normal(size=n), rng.normal(size=m)
        seen = list(mine.walk((a, b)))
        assert sorted((i, j) for i, j, _ in seen) == [(i, j) for i in range(n) for j in range(m)]
        assert all(x[2] >= y[2] for x, y in zip(seen, seen[1:])) and all(abs(a[i] + b[j] - s) < 1e-12 for i, j, s in seen)
    assert list(mine.walk((np.array([-np.inf]), np.array([1.0])))) == []


def test_walk_stops_in_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 200
    rows = [(i, i % 40 if i % 3 else 99, [int(x) for x in centres[i % 40] + rng.normal(size=16) * 4]) for i in range(6000)]
    report = {}
    v = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    n = mine.hard_negatives(v, F.col("vec_id") % 400 == 1, first=8, report=report).count()
    assert n > 0 and report["pairs"] < 0.5 * 2 * 15 * 6000  # both searches would read 15 x 6000 pairs each


def brute(rows):
    """Cheapest edits by trying all of them; rows are (role, text) in order."""
    seen, faults = set(), []
    for role, text in rows:
        core = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def go(i, roles, out, cost, audit):
        nonlocal best
        if len(roles) > 1 and not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if best is not None and cost > best[0]:
            return
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", roles):
                key = (cost, audit, "\n".join(out))
                best = key if best is None or key < best else best
        if audit[-2:] != "II":
            for r in ("user", "assistant"):
                go(i, roles + r[0], [*out, r + ":"], cost + 5, audit + "I")
        if i < len(rows):
            (role, text), extra = rows[i], 5 * (faults[i] == "truncated")
            go(i + 1, roles, out, cost + 2, audit + "D")
            if faults[i] not in ("blank", "duplicate"):
                go(i + 1, roles + (role[:1] or "?"), [*out, f"{role}:{text}"], cost + extra, audit + "K")
                for r in ("user", "assistant"):
                    go(i + 1, roles + r[0], [*out, f"{r}:{text}"], cost + extra + 1, audit + "R")

    go(0, "", [], 0, "")
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return tuple(faults.count(f) for f in ("blank", "duplicate", "truncated")) + (sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()), best[2]


def test_repair_brute_force(spark):
    rng = random.Random(9)
    rows, want, texts = [], {}, {}
    for c in range(120):
        turns, t = [], 0
        for _ in range(rng.randrange(1, 6)):
            t += rng.choice([0, 1, 1, 1, 2])
            turns.append((None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b!", "c", " ", None, "", "d? \n", "long " * 3000 + "."])))
        rows += [(c or None, *x, "extra", 1) for x in turns]
        fill = sorted(((x[0] is not None, x[0] or 0, " " if x[1] is None else x[1], " " if x[2] is None else x[2]) for x in turns))
        known = [x[0] for x in turns if x[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        digest, text = brute([(r, x) for _, _, r, x in fill])
        want[c or None], texts[c or None] = (gaps, *digest), text
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string, fault int")
    plans = conv.repair_plans(df, spill_bytes=4)
    assert {r[0]: tuple(r[1:]) for r in plans.collect()} == want
    got = {}
    for r in conv.repaired_turns(df, plans).collect():
        got.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    assert {c: "\n".join(x for _, x in sorted(p)) for c, p in got.items()} == {c: t for c, t in texts.items() if t}


def test_giant_conversation(spark):
    """The states cross batches and backpointers are spilled; pairs of good rows are all kept."""
    n = 40_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("row "), F.col("id"), F.lit(".")).alias("text"))
    df = df.withColumn("text", F.when(F.col("turn") == 777, "").otherwise(F.col("text")))
    r = conv.repair_plans(df, spill_bytes=1 << 12).collect()
    assert len(r) == 1 and r[0].blank == 1 and r[0].cost == 4 and len(r[0].audit) == n and r[0].audit.count("D") == 2
    text = "\n".join(f"{'assistant' if i % 2 else 'user'}:row {i}." for i in range(n) if r[0].audit[i] == "K")
    assert hashlib.sha256(text.encode()).hexdigest() == r[0].repaired_sha256


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "a. b! c?") for c in (1, 2, None) for t in (*range(40), None)]
    got = {}
    for r in conv.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.there))
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = ("user" if h == 4 else role, "" if h <= 1 else "a b c" if h == 2 else text, h != 0)
        assert got[c, t] == [row] * (2 if h == 3 else 1)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conv.repair_plans(conv.damaged(none)).collect() == []


