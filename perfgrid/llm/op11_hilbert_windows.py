"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, and queries are
scaled to length M with 0 there: the nearest point is then the largest inner product. Each
curve turns the points by a random orthonormal projection to ``dims`` axes, evens out each
axis by quantiles of a bounded sample, shifts the grid and orders the points along a Hilbert
curve. The keys of a curve are range-partitioned by Spark, so that every point has a place
in the order; a query reads the points at most ``window`` places away on every curve, and
the windows are merged and ranked by exact products.

The window is not guessed: for a bounded sample of queries (``probes``) the true neighbours
are found by one pass over all rows, and the window is the smallest one that reaches
``target`` of them on at least one curve. Clustered vectors get short windows; vectors
without any structure need windows that are a share of the table.

Equal vectors are one point that carries its k + 1 smallest ids, which is all that a query can
ask for, so a vector that a third of the rows share is one point of the order. Points lie in
blocks of ``block_rows``; a task compares one block with at most ``block_rows`` queries.

Vectors that are NULL, zero or hold NULL or non-finite components take no part, nor do rows
without vec_id. Only vectors of one length are compared. Repeated rows are rows of their own:
a query leaves out only its own row. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfgrid.llm.common import load, query, table
from perfgrid.llm.op2_segment_topk import finite, matrix
from perfgrid.operators.ranking import top_k
from perfgrid.session import broadcast_checked

FIT_ROWS, QUANTILES = 4096, 129
FOUND = "q long, c long, first long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points of a grid with 2**bits cells an axis, vectorized over
    points: the cube is turned axis by axis from the highest bit down, then Gray-coded bits are read."""
    x = cells.astype(np.int64).copy()
    axes, high = x.shape[1], np.int64(1) << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for a in range(axes):
            upper = (x[:, a] & q) != 0
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, a]) & low)
            x[:, 0] ^= np.where(upper, low, swap)
            x[:, a] ^= swap
        q >>= 1
    for a in range(1, axes):
        x[:, a] ^= x[:, a - 1]
    flip, q = np.zeros(len(x), np.int64), high
    while q > 1:
        flip ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for a in range(axes):
            key = (key << 1) | ((x[:, a] >> bit) & 1)
    return key


class Curves:
    """Projections, quantiles and shifts of all curves, fitted on a sample of points."""

    def __init__(self, sample: np.ndarray, norm: float, curves: int, dims: int, seed: int = 7):
        rng, wide = np.random.default_rng(seed), sample.shape[1] + 1
        self.norm, self.dims = norm, min(dims, wide)
        self.bits = min(16, 62 // self.dims)
        self.turns = [np.linalg.qr(rng.normal(size=(wide, wide)))[0][:, : self.dims] for _ in range(curves)]
        self.shifts = rng.random((curves, self.dims))
        points, at = self.points(sample), np.linspace(0, 1, QUANTILES)
        self.marks = [np.quantile(points @ t, at, axis=0) for t in self.turns]
        self.at = at

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        return np.concatenate([unit, np.zeros((len(x), 1))], axis=1)

    def keys(self, points: np.ndarray, curve: int) -> np.ndarray:
        p = points @ self.turns[curve]
        even = np.stack([np.interp(p[:, a], self.marks[curve][:, a], self.at) for a in range(self.dims)], axis=1)
        cells = ((even + self.shifts[curve]) * 0.5 * (1 << self.bits)).astype(np.int64)
        return hilbert_keys(np.minimum(cells, (1 << self.bits) - 1), self.bits)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in an order that does not depend on their place."""
    return (a * b).sum(axis=1)


def best_of(q: np.ndarray, c: np.ndarray, mask: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, score) of the k best of ``c`` for each row of ``q`` where ``mask`` allows; ties
    of the k-th are all kept, so that a later ranking can break them by id."""
    rows, cols, scores = [], [], []
    size = np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", c, c).max(initial=0.0))
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ c.T
        if mask is not None:
            s[~mask[a : a + 256]] = -np.inf
        if s.shape[1] > k:
            floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        else:
            floor = np.full(len(s), -np.inf)
        i, j = np.nonzero((s >= (floor - 1e-12 * size[a : a + 256])[:, None]) & (s > -np.inf))
        rows.append(i + a)
        cols.append(j)
        scores.append(products(q[i + a], c[j]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def true_neighbours(points: DataFrame, probes: pa.Table, dim: int, k: int) -> DataFrame:
    """(q, c, first, score): the k best points of each of a bounded number of queries, by one pass over all."""
    q = matrix(probes.column("v"), dim).astype(np.float64)
    shared = points.sparkSession.sparkContext.broadcast((q, probes.column("cls").to_numpy()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_ids = shared.value
        for batch in batches:
            c = matrix(batch.column("v"), dim).astype(np.float64)
            i, j, s = best_of(q, c, None, k)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), *(pa.array(batch.column(n).to_numpy()[j]) for n in ("cls", "first")), pa.array(s)], ["q", "c", "first", "score"])

    return top_k(points.select("cls", "v", "first").mapInArrow(scan, FOUND), ["q"], [F.desc("score"), F.asc("first"), F.asc("c")], k)


def places(points: DataFrame, curves: Curves, count: int, dim: int) -> DataFrame:
    """(curve, cls, is_query, pos): the place of every point and every query in each order; the place
    of a query is the number of points before it. Written, as range bounds must not be drawn twice."""
    shared = points.sparkSession.sparkContext.broadcast(curves)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["curve", "key", "is_query", "cls"]
        for batch in batches:
            x, ids = matrix(batch.column("v"), dim).astype(np.float64), batch.column("cls").to_numpy()
            asks = batch.column("queries").to_numpy() > 0
            p, q = shared.value.points(x), shared.value.queries(x[asks])
            for c in range(count):
                for rows, of, flag in ((p, ids, False), (q, ids[asks], True)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), c, np.int32)), pa.array(shared.value.keys(rows, c)), pa.array(np.full(len(of), flag)), pa.array(of)], names)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(count, np.int64)
        for batch in batches:
            curve, point = batch.column("curve").to_numpy(), ~batch.column("is_query").to_numpy(zero_copy_only=False)
            local = np.zeros(len(curve), np.int64)
            for c in np.unique(curve):
                on = curve == c
                upto = np.cumsum(point[on])
                local[on] = seen[c] + upto - point[on]
                seen[c] += upto[-1]
            yield pa.RecordBatch.from_arrays([batch.column("curve"), batch.column("cls"), batch.column("is_query"), pa.array(local), pa.array(np.full(len(curve), part, np.int32))], ["curve", "cls", "is_query", "local", "part"])

    keys = points.select("cls", "v", "queries").mapInArrow(keyed, "curve int, key long, is_query boolean, cls long")
    keys = table(keys, "keys")
    ranged = keys.repartitionByRange("curve", "key", "is_query", "cls").sortWithinPartitions("curve", "key", "is_query", "cls")
    local = table(ranged.mapInArrow(numbered, "curve int, cls long, is_query boolean, local long, part int"), "places")
    sums = local.groupBy("curve", "part").agg(F.sum(F.when(F.col("is_query"), 0).otherwise(1)).alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shift = table(sums.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")), "shifts")
    return local.join(broadcast_checked(shift, 32), ["curve", "part"]).select("curve", "cls", "is_query", (F.col("local") + F.col("shift")).alias("pos"))


def needed_window(truth: DataFrame, places: DataFrame, target: float) -> int:
    """Half-window that reaches ``target`` of the true pairs on at least one curve. The pairs are bounded
    by the probes."""
    truth = broadcast_checked(truth, 24)
    q = places.filter("is_query").join(truth.select(F.col("q").alias("cls"), "c"), "cls").select(F.col("cls").alias("q"), "c", "curve", F.col("pos").alias("at"))
    p = places.filter(~F.col("is_query")).join(truth.select("q", F.col("c").alias("cls")), "cls").select("q", F.col("cls").alias("c"), "curve", "pos")
    away = q.join(p, ["q", "c", "curve"]).groupBy("q", "c").agg(F.min(F.abs(F.col("pos") - F.col("at"))).alias("away"))
    far = np.sort(np.array([r.away for r in away.collect()], np.int64))
    return int(far[min(len(far) - 1, int(np.ceil(target * len(far))))]) + 1 if len(far) else 1


def window_pairs(points: DataFrame, places: DataFrame, window: int, dim: int, k: int, block_rows: int) -> DataFrame:
    """(q, c, first, score): the k best of each query in each block that its windows touch, written."""
    block = lambda p: F.floor(p / block_rows).cast("long")
    p = places.filter(~F.col("is_query")).select("curve", "cls", "pos", block(F.col("pos")).alias("block"))
    q = places.filter("is_query").select("curve", "cls", "pos", F.explode(F.sequence(block(F.greatest(F.lit(0), F.col("pos") - window)), block(F.col("pos") + window - 1))).alias("block"))
    q = q.join(p.groupBy("curve").agg(F.max("block").alias("last")), "curve").filter("block <= last").drop("last")
    chunks = q.groupBy("curve", "block").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("chunks"))
    chunks = broadcast_checked(table(chunks, "chunks"), 32)
    q = q.join(chunks, ["curve", "block"]).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")).drop("chunks")
    p = p.join(chunks, ["curve", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    v, keys = points.select("cls", "v", "first"), ["curve", "block", "chunk"]
    n = max(1, min(10_000, 2 * p.select("curve", "block", "chunk").distinct().count()))
    p = p.join(v, "cls").select(*keys, "cls", "first", "v", "pos")
    q = q.join(v, "cls").select(*[F.col(x).alias(x) for x in keys], F.col("cls").alias("q"), F.col("v").alias("ask"), F.col("pos").alias("at"))
    q, p = (x.repartition(n, *keys).groupBy(*keys) for x in (q, p))

    def compare(asks: pa.Table, has: pa.Table) -> pa.Table:
        if not asks.num_rows or not has.num_rows:
            none = pa.array([], pa.int64())
            return pa.table({"q": none, "c": none, "first": none, "score": pa.array([], pa.float64())})
        a, b = (matrix(t, dim).astype(np.float64) for t in (asks.column("ask"), has.column("v")))
        at, pos = asks.column("at").to_numpy(), has.column("pos").to_numpy()
        near = (pos[None, :] >= at[:, None] - window) & (pos[None, :] < at[:, None] + window)
        i, j, s = best_of(a, b, near, k)
        return pa.table({"q": asks.column("q").to_numpy()[i], "c": has.column("cls").to_numpy()[j], "first": has.column("first").to_numpy()[j], "score": s})

    return table(q.cogroup(p).applyInArrow(compare, FOUND), "near")


def nearest(vectors: DataFrame, is_query, k: int = 20, curves: int = 12, dims: int = 8, target: float = 0.94, probes: int = 256, block_rows: int = 4096, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for rows (vec_id, embedding). ``report`` receives the window and
    the number of points for each length of vectors."""
    spark = vectors.sparkSession
    v = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    alive = vectors.filter(finite("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull())
    rows = alive.select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = table(rows.withColumn("ask", is_query.cast("int")), "vectors")
    few = top_k(rows, ["v"], [F.asc("vec_id"), F.asc("_row")], k + 1)
    points = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "_row"))).alias("ids"), F.min("_row").alias("cls"))
    asked = rows.filter("ask = 1").groupBy("v").agg(F.count(F.lit(1)).alias("queries"))
    points = table(points.join(asked, "v", "left").select("cls", "v", "ids", F.col("ids")[0]["vec_id"].alias("first"), F.coalesce("queries", F.lit(0)).alias("queries"), F.size("v").alias("dim")), "points")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    found = None
    for r in points.groupBy("dim").agg(F.max(F.sqrt(square)).alias("norm"), F.sum("queries").alias("asks"), F.count(F.lit(1)).alias("n")).collect():
        if not r.asks:
            continue
        same, dim = points.filter(F.col("dim") == r.dim), r.dim
        by_hash = lambda d, n: d.orderBy(F.xxhash64("cls"), "cls").limit(n).select("cls", "v").toArrow()
        fit = Curves(matrix(by_hash(same, FIT_ROWS).column("v"), dim).astype(np.float64), r.norm, curves, dims)
        at = table(places(same, fit, curves, dim), "order")
        truth = table(true_neighbours(same, by_hash(same.filter("queries > 0"), probes), dim, k), "truth")
        window = needed_window(truth, at, target)
        if report is not None:
            report[dim] = {"points": r.n, "window": window}
        near = window_pairs(same, at, window, dim, k + 1, block_rows)
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pairs = top_k(found.distinct(), ["q"], [F.desc("score"), F.asc("first"), F.asc("c")], k + 1)
    pairs = pairs.join(points.select(F.col("cls").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("e"))
    lists = top_k(pairs.select("q", "score", "e.vec_id", "e._row"), ["q"], [F.desc("score"), F.asc("vec_id"), F.asc("_row")], k + 1)
    lists = lists.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "_row", "score"))).alias("best"))
    asks = rows.filter("ask = 1").join(points.select("v", F.col("cls").alias("q")), "v").select("_row", F.col("vec_id").alias("query_id"), "q")
    own = asks.join(lists, "q").select("query_id", F.slice(F.filter("best", lambda b: b["_row"] != F.col("_row")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


@query("op11_hilbert_windows")
def hilbert_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
