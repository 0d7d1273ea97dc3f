"""Top-k, embeddings, near-duplicates and repeated passages against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from perfgrid.llm import op2_segment_topk as topk
from perfgrid.llm import op4_tensor_minhash as near
from perfgrid.llm import op8_bwt_merge as bwt
from perfgrid.llm import op9_int8_tiles as tiles
from perfgrid.llm.common import table
from perfgrid.llm.components import components
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int"


def reach(nodes, links):
    comp = {n: n for n in nodes}
    for _ in nodes:
        before = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            break
    return comp


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == reach(sorted(nodes), edges)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], int(rng.integers(3))) for i in range(1, 90)]
    rows += [(100 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, i % 3 / 50], 1) for i in range(60)]
    rows += [(200, None, 1), (201, [nan] * 8, 1), (202, [inf] + [0.0] * 7, 1), (203, [None] + [1.0] * 7, 1), (204, [0.0] * 8, 1), (205, [1.0] * 8, None), (206, [1.0, 2.0], 1), (207, [], 1)]
    rows += [(100, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (None, [1.0] * 8, 2), (50, [1e30] * 8, 0), (51, [1e-30] * 8, 0)]
    return rows, spark.createDataFrame(rows, VECTORS)


def test_topk_brute_force(spark):
    rows, df = odd_vectors(spark)
    rows = [r for r in rows if r[0] not in (50, 51) or abs(r[1][0]) < 1e20]
    df = spark.createDataFrame(rows, VECTORS).filter(topk.finite("embedding") & F.col("vec_id").isNotNull())
    v = table(df.select(F.monotonically_increasing_id().alias("_row"), "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v")))
    got = sorted(map(tuple, topk.top_products(v, F.col("vec_id") % 10 == 0, 5, block_bytes=256).collect()))
    all_rows, want = v.collect(), []
    for q in all_rows:
        if q.vec_id % 10 == 0:
            s = sorted((-sum(a * b for a, b in zip(q.v, c.v)), c.vec_id) for c in all_rows if c._row != q._row and len(c.v) == len(q.v))[:5]
            want += [(q.vec_id, i + 1, b, -a) for i, (a, b) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_products(table(v.limit(0)), F.lit(True)).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-300, 300, (40, 64)).astype(float), rng.integers(-300, 300, (50, 64)).astype(float)
    for n in topk.LEVELS:
        assert (topk.segment_stats(x, n) @ topk.segment_stats(y, n).T >= x @ y.T - 1e-6).all()


@pytest.mark.parametrize("tile_rows", [8, 4096])
def test_embeddings_brute_force(spark, tile_rows):
    rows, df = odd_vectors(spark)
    got = sorted(map(tuple, tiles.near_vectors(df, 0.93, tile_rows).collect()), key=str)
    live = [(i, r) for i, r in enumerate(rows) if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    unit = {i: np.array(np.array(r[1], np.float32), float) / np.linalg.norm(np.array(np.array(r[1], np.float32), float)) for i, r in live}
    links = [(i, j) for i, a in live for j, b in live if i < j and a[2] == b[2] and len(a[1]) == len(b[1]) and unit[i] @ unit[j] >= 0.93]
    comp = reach(range(len(rows)), links)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[comp[i]] = min(least.get(comp[i], r[0]), r[0])
    n = {i: sum(i in e for e in links) for i in range(len(rows))}
    want = [(r[0], n[i], least.get(comp[i]), r[0] == least.get(comp[i])) for i, r in enumerate(rows)]
    assert got == sorted(want, key=str)
    assert tiles.near_vectors(df.limit(0), 0.93).collect() == []


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def near_docs():
    rng = random.Random(7)
    rows, words = [], [f"w{i}" for i in range(400)]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 60, 200]))]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_brute_force(docs_of, words, percent):
    from tests_llm_rows import ODD

    rows = near_docs() + [((r[0] or 0) + 1000, *r[1:]) for r in ODD]
    got = near.near_components(docs_of(rows), words, percent).collect()
    sets = [shingles(r[1], words) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = reach(range(len(rows)), links)
    least = {}
    for i, r in enumerate(rows):
        least[comp[i]] = min(least.get(comp[i], r[0]), r[0])
    want = sorted((r[0], len(sets[i]), least[comp[i]]) for i, r in enumerate(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_near_odd(odd, none):
    got = near.near_components(odd, 3, 85).collect()
    assert len(got) == 8 and {r.component_id for r in got if r.n_shingles == 5} == {3}
    assert near.near_components(none, 3, 85).collect() == []
    kept = near.without_near(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (True, 1), (True, 2), (True, 4), (True, 5), (True, 6)]


def test_near_keeps_other_columns(odd):
    more = odd.selectExpr("*", "1 AS _c", "2 AS rep", "3 AS digest", "4 AS component_id")
    assert near.without_near(more).columns == more.columns


def test_missed_pairs_are_rare():
    for t in (0.8, 0.85):
        m, p = near.collections_for(t), t * t
        assert (1 - p) ** m + m * p * (1 - p) ** (m - 1) <= near.MISS


def brute_repeats(rows, span=100):
    seen, out = set(), []
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1):
            w = b[p : p + span]
            if w in seen:
                gone[p : p + span] = b"\1" * span
            seen.add(w)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def passages(seed, n):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdefgh é\n") for _ in range(rng.randint(90, 400))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            r, s = rng.random(), rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts.append(s[a : a + rng.randint(50, 400)] if r < 0.5 else "ab" * rng.randint(10, 200) if r < 0.6 else "z" * rng.randint(50, 400) if r < 0.65 else "".join(rng.choice("abc") for _ in range(rng.randint(1, 200))))
        rows.append((i * 7 % (n + 1 if (n + 1) % 7 else n), "".join(parts)))
    return rows


def test_repeats_brute_force(spark, sf):
    rows = passages(5, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, bwt.without_repeats(df).collect())) == sorted(brute_repeats(rows))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, bwt.bwt_merge(spark, sf).collect())) == sorted(brute_repeats(rows))


def test_repeats_odd(odd, none):
    from tests_llm_rows import ODD

    rows = [(-1 if r[0] is None else r[0], r[1]) for r in ODD]
    got = sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in bwt.without_repeats(odd).collect())
    assert got == sorted(brute_repeats(rows))
    assert bwt.without_repeats(none).collect() == []


@pytest.mark.parametrize("shard", [3, 16, 1000])
def test_merged_transforms_sort(shard):
    rng = np.random.default_rng(9)
    rows = rng.integers(97, 99, (70, 37), dtype=np.uint8)
    rows[[5, 9, 40]] = rows[20]
    order, shared = bwt.ordered(rows, shard)
    text = [bytes(rows[i]) for i in order]
    assert text == sorted(text)
    for a, b, n in zip(text, text[1:], shared[1:]):
        assert min(n, 37) == next((i for i in range(37) if a[i] != b[i]), 37)
