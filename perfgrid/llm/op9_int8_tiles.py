"""Embedding near-duplicates by int8 tiles with error bounds.

Unit vectors are stored as int8 numbers and one scale each, with the exact length e of what
rounding lost. The product of two vectors differs from that of their int8 forms by at most
|q| e' + e |q'| + e e', so only pairs whose int8 product plus this bound reaches the threshold
are computed again in double precision.

Equal vectors of a label are one class with a count. The classes of a label are dealt to
blocks of at most about ``tile_rows`` rows, and each pair of blocks is one task. A tile
returns, for each class, how many vectors it is linked with and one edge of a spanning
forest: as many rows as it got, whatever the number of links.

Rows without a label, and vectors that are NULL, zero or hold NULL or non-finite components,
link with nothing: n_links 0, a component of their own. Vectors of different lengths are not
compared. Repeated rows are vectors of their own. A NULL vec_id stays NULL; a component's id is its
smallest vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfgrid.llm.common import load, query, table
from perfgrid.llm.components import components
from perfgrid.llm.op2_segment_topk import finite, matrix


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, lengths of the scaled int8 rows and of the rounding errors of unit vectors."""
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    lost = unit - back
    return q, scale, np.sqrt(np.einsum("ij,ij->i", back, back)), np.sqrt(np.einsum("ij,ij->i", lost, lost)) + 1e-14


def halved(x: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, which is exact, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (row of x, row of y) by cosine in double precision; ``own``: x is y, pairs once."""
    x, y = halved(x), halved(y)
    qx, sx, nx, ex = quantise(x)
    qy, sy, ny, ey = quantise(y)
    lx, ly = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    fy, found = qy.astype(np.float32).T, []  # products of int8 numbers are whole and below 2**24 up to 1040 components
    wide = np.float32 if x.shape[1] <= 1040 else np.float64
    fy = fy.astype(wide)
    for a in range(0, len(x), 256):
        s = slice(a, a + 256)
        near = (qx[s].astype(wide) @ fy) * sx[s][:, None] * sy[None, :]
        near += nx[s][:, None] * ey[None, :] + ex[s][:, None] * (ny + ey)[None, :]
        i, j = np.nonzero(near >= threshold - 1e-9)
        if own:
            i, j = i[i + a < j], j[i + a < j]
        for b in range(0, len(i), 65536):
            u, v = i[b : b + 65536] + a, j[b : b + 65536]
            good = np.einsum("ij,ij->i", x[u], y[v]) / (lx[u] * ly[v]) >= threshold
            found.append((u[good], v[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def near_vectors(vectors: DataFrame, threshold: float, tile_rows: int = 4096) -> DataFrame:
    """Adds n_links, component_id, kept to rows (vec_id, embedding, label)."""
    v = vectors.select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    v = table(v, "vectors")
    alive = v.filter(F.col("label").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0))
    classes = alive.groupBy("label", "embedding").agg(F.min("_row").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = table(classes.withColumn("dim", F.size("embedding")), "classes")
    blocks = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("blocks"))
    c = classes.join(blocks, ["label", "dim"]).withColumn("_b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    c = c.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = c.select("label", "dim", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), "_b", "rep", "copies", "embedding")

    def tile(t: pa.Table) -> pa.Table:
        dim, i, j = (t.column(n)[0].as_py() for n in ("dim", "i", "j"))
        x, b = matrix(t.column("embedding"), dim), t.column("_b").to_numpy()
        rep, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
        u, w = tile_links(x[left], x[right], threshold, i == j)
        u, w = left[u], right[w]
        links = np.bincount(u, weights=copies[w], minlength=len(x)) + np.bincount(w, weights=copies[u], minlength=len(x))
        root = rep[forest(len(x), u, w)]
        some = (links > 0) | (root != rep)
        return pa.table({"rep": rep[some], "links": links[some].astype(np.int64), "root": root[some]})

    n = F.col("blocks").cast("long")
    tasks = blocks.agg(F.sum(n * (n + 1) / 2)).first()[0] or 1
    tiles = tiles.repartition(int(min(tasks, 10_000)), "label", "dim", "i", "j")  # tiles are few bytes and much work: not to be merged
    found = table(tiles.groupBy("label", "dim", "i", "j").applyInArrow(tile, "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    member = alive.join(classes, ["label", "embedding"]).select("_row", "rep", "copies")
    member = member.join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    member = member.select("_row", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("_c"))
    rows = v.select("_row", "vec_id").join(member, "_row", "left").withColumn("_c", F.coalesce("_c", "_row"))
    rows = table(rows, "members")
    names = rows.groupBy("_c").agg(F.min("vec_id").alias("component_id"))
    out = rows.join(names, "_c").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
c AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT l.b, c.m FROM c JOIN l ON c.n = l.a),
g AS (SELECT n, min(m) AS component_id FROM c GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, g.component_id, e.vec_id = g.component_id AS kept
FROM embeddings e JOIN g ON g.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""


@query("op9_int8_tiles", SQL)
def int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"), 0.93)
