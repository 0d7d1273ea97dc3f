"""Exact top-k inner products with bounds from segment means and deviations.

Cut into segments of length L, two vectors of segment means m and deviations s have an
inner product of at most the sum of L (m m' + s s'), that is a squared distance of at
least the sum of L ((m - m')^2 + (s - s')^2). Bounds are taken from coarse to fine; pairs
whose bound is below the k-th best score seen so far are left out, the rest get the exact
integer product.

Queries go out in blocks of bounded bytes, each broadcast for one pass over all
candidates; a task returns at most k rows for each query of the block.

Vectors that are NULL or hold NULL or non-finite components take no part, nor do rows
without vec_id. Only vectors of one length are compared. Repeated rows are rows of their
own; a query leaves out only its own row. Products must stay below 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfgrid.llm.common import load, query, table
from perfgrid.operators.ranking import top_k

LEVELS = (1, 4, 16)


def finite(vector: str):
    """True for a vector without NULL and non-finite components."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(F.col(vector), ok), F.lit(False))


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(L) (mean, deviation) for each segment, so that bounds are plain products."""
    parts = [p for p in np.array_split(x, min(segments, max(1, x.shape[1])), axis=1) if p.shape[1]]
    cols = [np.sqrt(p.shape[1]) * f for p in parts for f in (p.mean(axis=1), p.std(axis=1))]
    return np.stack(cols, axis=1) if cols else np.zeros((len(x), 0))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All integer products; through doubles where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.q, self.s, self.i = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        q, s, i = (np.concatenate(x) for x in ((self.q, q), (self.s, s), (self.i, i)))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        self.q, self.s, self.i = q[keep], s[keep], i[keep]
        full = np.arange(len(q)) - first == self.k - 1
        self.floor[q[full]] = s[full]


def search(q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, best: Best, q_no: np.ndarray, q_stats: list[np.ndarray]) -> None:
    """Adds the candidates ``c`` to ``best`` for the queries ``q`` (integer rows)."""
    c_stats = [segment_stats(c.astype(np.float64), n) for n in LEVELS]
    for a in range(0, len(q), 128):
        some = slice(a, a + 128)
        floor = best.floor[q_no[some]]
        open_ = np.ones((len(floor), len(c)), bool)
        for qs, cs in zip(q_stats, c_stats):
            if open_.mean() > 0.05:
                bound = qs[some] @ cs.T
                open_ &= bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 >= floor[:, None]
            else:
                i, j = np.nonzero(open_)
                bound = np.einsum("ij,ij->i", qs[some][i], cs[j])
                open_[i, j] = bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 >= floor[i]
        open_ &= q_rows[some][:, None] != c_rows[None, :]
        rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if not len(rows):
            continue
        if open_.mean() > 0.02:
            scores = exact_products(q[some][rows], c[cols])
            i, j = np.nonzero(open_[np.ix_(rows, cols)] & (scores >= floor[rows][:, None]))
            best.add(q_no[some][rows[i]], scores[i, j], c_ids[cols[j]])
        else:
            i, j = np.nonzero(open_)
            scores = np.einsum("ij,ij->i", q[some][i], c[j])
            good = scores >= floor[i]
            best.add(q_no[some][i[good]], scores[good], c_ids[j[good]])


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def top_products(vectors: DataFrame, is_query, k: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank, vec_id, score for rows (_row, vec_id, v array<long>); ``vectors`` has to be
    a written table. ``block_bytes`` bounds what is broadcast at once."""
    spark, parts = vectors.sparkSession, []
    dims = [(r["d"], r["n"]) for r in vectors.filter(is_query).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()]
    for dim, n in dims:
        blocks = max(1, -(-n * 8 * max(1, dim) // block_bytes))
        same = vectors.filter(F.size("v") == dim)
        for b in range(blocks):
            block = same.filter(is_query).filter(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == b).select("_row", "vec_id", "v").toArrow()
            if block.num_rows == 0:
                continue
            q = matrix(block.column("v"), dim) if dim else np.zeros((block.num_rows, 0), np.int64)
            shared = spark.sparkContext.broadcast((q, block.column("_row").to_numpy(), block.column("vec_id").to_numpy(), [segment_stats(q.astype(np.float64), n) for n in LEVELS]))

            def scan(batches: Iterator[pa.RecordBatch], shared=shared, dim=dim) -> Iterator[pa.RecordBatch]:
                q, q_rows, q_ids, q_stats = shared.value
                best, numbers = Best(len(q), k), np.arange(len(q))
                for batch in batches:
                    for a in range(0, batch.num_rows, 1024):
                        part = batch.slice(a, 1024)
                        c = matrix(part.column("v"), dim) if dim else np.zeros((part.num_rows, 0), np.int64)
                        search(q, q_rows, c, part.column("vec_id").to_numpy(), part.column("_row").to_numpy(), best, numbers, q_stats)
                for a in range(0, len(best.q), 65536):
                    s = slice(a, a + 65536)
                    cols = (q_rows[best.q[s]], q_ids[best.q[s]], best.i[s], best.s[s])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["_query", "query_id", "vec_id", "score"])

            found = same.select("_row", "vec_id", "v").mapInArrow(scan, "_query long, query_id long, vec_id long, score long")
            parts.append(table(top_k(found, ["_query", "query_id"], [F.desc("score"), F.asc("vec_id")], k), "topk"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op2_segment_topk", SQL)
def segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").filter(finite("embedding") & F.col("vec_id").isNotNull())
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    vectors = table(e.select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")), "vectors")
    return top_products(vectors, F.col("vec_id") % 50 == 0)
