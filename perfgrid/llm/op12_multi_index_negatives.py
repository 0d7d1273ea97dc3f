"""Hard negatives by an inverted multi-index with certified windows.

Vectors are cut into two halves, each half has a codebook of centres, and a pair of centres is
a cell. For an anchor q a half with centre c and radius r (the largest distance of a member
half from it) scores at most q.c + |q| r and at least q.c - |q| r, so a cell scores at most
the sum of its two upper half scores. A heap over the two sorted lists of half scores, the
multi-sequence walk, visits an anchor's cells in falling order of that bound.

Cells are visited in rounds of growing length, all anchors together: the walk names the next
cells, Spark joins them with the cell directory and takes each shard of rows to the anchors
that asked for it, and the best rows so far are kept for each window. A window is the range
of scores that is wanted and the label rule: first the best rows of the anchor's own label, then
for each of these positives the best rows of other labels between ``low`` and ``high`` percent
of its score. Cells whose bounds miss every open window are passed over. A window is certified,
and an anchor stops, when the next bound is below the k-th score found or below the window's lower
end. Results are exact; the codebooks, fitted on a bounded sample, only decide how much is read.

Rows are kept in shards of about ``shard_rows`` rows sorted by cell; a cell of very many
rows spans several shards, and a task compares a shard with at most about 2048 anchors. The number of centres grows with the root of the rows up to 1024.

Rows with a NULL label, a NULL vector or any NULL or non-finite component take no part, nor do rows
without vec_id. Only vectors of one length are compared. Repeated rows are rows of their own.
An empty table gives no rows; other columns are not read. Products must stay below 2**53.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfgrid.llm.common import load, query, table
from perfgrid.llm.op2_segment_topk import finite, matrix
from perfgrid.operators.ranking import top_k
from perfgrid.session import broadcast_checked

FIT_ROWS, CELL_ROWS, MOST_CENTRES, ASKERS = 20_000, 64, 1024, 2048
HIT = "row long, pid long, score long, vec_id long, hit long"


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = x.shape[1] // 2
    return x[:, :cut], x[:, cut:]


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2.0 * (x @ centres.T), axis=1) if x.shape[1] else np.zeros(len(x), np.int64)


def codebook(x: np.ndarray, count: int, sweeps: int = 8, seed: int = 3) -> np.ndarray:
    """Centres of a bounded sample of halves; a centre without members keeps its place."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[: max(1, count)]].astype(np.float64)
    for _ in range(sweeps):
        code = nearest_centre(x, centres)
        n = np.bincount(code, minlength=len(centres))
        sums = np.stack([np.bincount(code, weights=x[:, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros((len(centres), 0))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Index:
    """Codebooks and radii of both halves: all that the walk needs to know."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray]):
        self.books, self.radii = books, radii

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(upper, lower) half scores of one anchor, with room for rounding."""
        out = []
        for part, book, radius in zip(halves(q[None, :].astype(np.float64)), self.books, self.radii):
            mid, slack = book @ part[0], np.sqrt(part[0] @ part[0]) * radius
            room = 1e-9 * (np.abs(mid) + slack) + 1e-9
            out.append((np.where(radius < 0, -np.inf, mid + slack + room), mid - slack - room))
        return out


def walk(upper: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, float]]:
    """Multi-sequence walk: cells (i, j) in falling order of the sum of their half bounds. Halves
    without members (bound -inf) are never reached."""
    a, b = (np.argsort(-u, kind="stable") for u in upper)
    a, b = a[np.isfinite(upper[0][a])], b[np.isfinite(upper[1][b])]
    if not len(a) or not len(b):
        return
    reach = np.zeros(len(a), np.int64)  # cells of each row of the grid taken so far
    heap = [(-(upper[0][a[0]] + upper[1][b[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j]), -bound
        reach[i] = j + 1
        if j + 1 < len(b) and (i == 0 or reach[i - 1] > j + 1):
            heapq.heappush(heap, (-(upper[0][a[i]] + upper[1][b[j + 1]]), i, j + 1))
        if i + 1 < len(a) and reach[i + 1] == j:
            heapq.heappush(heap, (-(upper[0][a[i + 1]] + upper[1][b[j]]), i + 1, j))


def open_floor(windows: list[dict], k: int) -> list[tuple[int, int]]:
    """(floor, high) of each window: a cell matters where its upper bound reaches the floor and its
    lower bound does not exceed ``high``."""
    out = []
    for w in windows:
        floor = w["best"][k - 1]["score"] if len(w["best"]) >= k else w["low"]
        out.append((max(floor, w["low"]), w["high"]))
    return out


def next_cells(shared, k: int, most: int):
    """Names the next ``most`` cells of each open anchor, in one row for each code of the first half. A row
    without code tells how many cells were passed and whether more may follow."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        wide = len(index.books[1])
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for row, v, visited, windows in zip(*(batch.column(n).to_pylist() for n in ("row", "v", "visited", "windows"))):
                (up_a, low_a), (up_b, low_b) = index.bounds(np.array(v, np.int64))
                spans, passed, got = open_floor(windows, k), 0, 0
                lowest = min((f for f, _ in spans), default=np.inf)
                named: dict[int, list[int]] = {}
                for i, j, bound in walk((up_a, up_b)):
                    if bound < lowest or got >= most:
                        break
                    passed += 1
                    if passed <= visited:
                        continue
                    low = low_a[i] + low_b[j]
                    if any(bound >= f and low <= h for f, h in spans):
                        named.setdefault(i, []).append(i * wide + j)
                        got += 1
                for line in (*((row, i, cells, None, None) for i, cells in named.items()), (row, None, None, passed, got >= most)):
                    for col, x in zip(rows, line):
                        col.append(x)
            types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["row", "code", "cells", "visited", "more"])

    return ask


def cell_scores(q: np.ndarray, wants: list[list[int]], x: np.ndarray, cell: np.ndarray) -> Iterator[tuple[int, list]]:
    """(anchor, [(from, to, scores)]) over the cells each anchor asked for: one product for each cell
    and 256 anchors. Rows of ``x`` are sorted by cell."""
    for a in range(0, len(q), 256):
        askers: dict[int, list[int]] = {}
        for i, cells in enumerate(wants[a : a + 256]):
            for c in cells:
                askers.setdefault(c, []).append(i)
        scores: list[list] = [[] for _ in wants[a : a + 256]]
        for c, who in askers.items():
            lo, hi = np.searchsorted(cell, [c, c + 1])
            if lo < hi:
                for i, s in zip(who, q[a : a + 256][who] @ x[lo:hi].T):
                    scores[i].append((lo, hi, s))
        yield from ((a + i, parts) for i, parts in enumerate(scores) if parts)


def best_in_shard(k: int):
    """Compares the rows of a shard with the anchors that asked for some of its cells."""

    def compare(asks: pa.Table, has: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if asks.num_rows and has.num_rows:
            dim = len(has.column("v")[0])
            order = np.argsort(has.column("cell").to_numpy(), kind="stable")
            x, cell = matrix(has.column("v"), dim)[order].astype(np.float64), has.column("cell").to_numpy()[order]
            label, ids, rows = (has.column(n).to_numpy()[order] for n in ("label", "vec_id", "hit"))
            q, me, own = matrix(asks.column("q"), dim).astype(np.float64), asks.column("row").to_numpy(), asks.column("anchor_label").to_numpy()
            wants, windows = asks.column("cells").to_pylist(), asks.column("windows").to_pylist()
            for a, parts in cell_scores(q, wants, x, cell):
                at, s = np.concatenate([np.arange(lo, hi) for lo, hi, _ in parts]), np.concatenate([p[2] for p in parts]).astype(np.int64)
                mine, other = label[at] == own[a], rows[at] != me[a]
                for w, (floor, high) in zip(windows[a], open_floor(windows[a], k)):
                    good = np.flatnonzero((mine if w["own"] else ~mine) & other & (s >= floor) & (s <= high))
                    if len(good) > k:
                        kth = np.partition(s[good], len(good) - k)[len(good) - k]
                        good = good[s[good] >= kth]
                    good = good[np.lexsort((rows[at[good]], ids[at[good]], -s[good]))][:k]
                    for o, col in zip(out, (np.full(len(good), me[a]), np.full(len(good), w["pid"]), s[good], ids[at[good]], rows[at[good]])):
                        o.append(col)
        cols = [np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64) for o in out]
        return pa.table(dict(zip(("row", "pid", "score", "vec_id", "hit"), cols)))

    return compare


def certified(anchors: DataFrame, rows: DataFrame, directory: DataFrame, shared, k: int, shards: int, first: int, report: dict | None) -> DataFrame:
    """Fills the windows of all anchors. Each round visits four times as many cells as the one before;
    anchors without an open window leave the rounds."""
    done, most = None, first
    while True:
        named = table(anchors.select("row", "v", "visited", "windows").mapInArrow(next_cells(shared, k, most), "row long, code int, cells array<long>, visited int, more boolean"), "cells")
        asks = named.filter("code IS NOT NULL").select("row", "code", "cells").join(directory, "code")
        asks = asks.groupBy("row", "shard").agg(F.flatten(F.collect_list("cells")).alias("cells"))
        light = anchors.select("row", "windows", F.col("label").alias("anchor_label"), F.col("v").alias("q"))
        asks = asks.join(light, "row")
        chunks = asks.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("chunks"))
        chunks = broadcast_checked(table(chunks, "chunks"), 16)
        asks = asks.join(chunks, "shard").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).drop("chunks")
        has = rows.join(chunks, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        asks, has = (x.repartition(shards, "shard", "chunk").groupBy("shard", "chunk") for x in (asks, has))
        hits = table(asks.cogroup(has).applyInArrow(best_in_shard(k), HIT), "hits")
        if report is not None:
            sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
            seen = named.select(F.explode("cells").alias("cell")).join(sizes, "cell").agg(F.sum("n")).first()[0]
            report["rounds"] = report.get("rounds", 0) + 1
            report["pairs"] = report.get("pairs", 0) + (seen or 0)
        old = anchors.select("row", F.explode("windows").alias("w")).select("row", F.col("w.pid").alias("pid"), F.explode("w.best").alias("b")).select("row", "pid", "b.score", "b.vec_id", F.col("b.row").alias("hit"))
        best = top_k(old.unionByName(hits), ["row", "pid"], [F.desc("score"), F.asc("vec_id"), F.asc("hit")], k)
        best = best.groupBy("row", "pid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id", F.col("hit").alias("row")))).alias("b"))
        best = best.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pid", F.transform("b", lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"), x["row"].alias("row")))))).alias("found"))
        step = named.filter("code IS NULL").select("row", "visited", "more")
        fill = lambda w: F.struct(w["pid"].alias("pid"), w["own"].alias("own"), w["low"].alias("low"), w["high"].alias("high"), F.coalesce(F.try_element_at("found", w["pid"]), w["best"]).alias("best"))
        now = anchors.drop("visited").join(step, "row").join(best, "row", "left")
        now = table(now.select("row", "vec_id", "label", "v", "visited", F.transform("windows", fill).alias("windows"), "more"), "anchors")
        ready = now.filter(~F.col("more")).drop("more")
        done = ready if done is None else done.unionByName(ready)
        anchors, most = now.filter("more").drop("more"), most * 4
        if anchors.isEmpty():
            return done


def sharded(rows: DataFrame, dim: int, shard_rows: int) -> tuple[DataFrame, DataFrame, Index, int]:
    """Rows with cell and shard, the directory (first-half code, shard), the index and the number of shards."""
    n = rows.count()
    centres = int(min(MOST_CENTRES, max(1, np.sqrt(n / CELL_ROWS))))
    sample = matrix(rows.orderBy(F.xxhash64("hit"), "hit").limit(FIT_ROWS).select("v").toArrow().column("v"), dim).astype(np.float64)
    books = tuple(codebook(h, centres) for h in halves(sample))
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            parts = halves(matrix(batch.column("v"), dim).astype(np.float64))
            codes = [nearest_centre(h, b) for h, b in zip(parts, books)]
            far = [np.sqrt(((h - b[c]) ** 2).sum(axis=1)) for h, b, c in zip(parts, books, codes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes[0] * len(books[1]) + codes[1]), *map(pa.array, far)], [*batch.schema.names, "cell", "far_a", "far_b"])

    coded = table(rows.mapInArrow(code, "hit long, vec_id long, label int, v array<long>, cell long, far_a double, far_b double"), "coded")
    wide, radii = len(books[1]), []
    for name, book, of in (("far_a", books[0], F.floor(F.col("cell") / wide)), ("far_b", books[1], F.col("cell") % wide)):
        r = np.full(len(book), -1.0)  # no member
        for x in coded.groupBy(of.cast("int").alias("c")).agg(F.max(name).alias("far")).collect():  # a row for each centre
            r[x.c] = x.far
        radii.append(r)
    shards = max(1, -(-n // shard_rows))
    ranged = coded.drop("far_a", "far_b").repartitionByRange(shards, "cell", F.xxhash64("hit")).withColumn("shard", F.spark_partition_id())
    placed = table(ranged, "shards")
    directory = table(placed.select(F.floor(F.col("cell") / wide).cast("int").alias("code"), "shard").distinct(), "directory")
    return placed, broadcast_checked(directory, 16), Index(books, tuple(radii)), shards


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, shard_rows: int = 4096, first: int = 64, report: dict | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id,
    label, v array<long>). ``low`` and ``high`` are percent of the positive's score."""
    spark, parts = vectors.sparkSession, []
    rows = vectors.select(F.monotonically_increasing_id().alias("hit"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "v")
    rows = table(rows, "vectors")
    empty = F.expr("cast(array() as array<struct<score:long,vec_id:long,row:long>>)")
    for d in [r[0] for r in rows.filter(is_anchor).select(F.size("v")).distinct().collect()]:
        placed, directory, index, shards = sharded(rows.filter(F.size("v") == d), d, shard_rows)
        shared = spark.sparkContext.broadcast(index)
        anyone = F.struct(F.lit(-1).cast("long").alias("pid"), F.lit(1).alias("own"), F.lit(-(2**53)).cast("long").alias("low"), F.lit(2**53).cast("long").alias("high"), empty.alias("best"))
        a = placed.filter(is_anchor).select(F.col("hit").alias("row"), "vec_id", "label", "v", F.lit(0).alias("visited"), F.array(anyone).alias("windows"))
        a = table(certified(a, placed, directory, shared, positives, shards, first, report), "positives")
        # a score s lies in the window of a positive score p if low p <= 100 s <= high p
        bottom, top = (lambda p: F.ceil(p * low / F.lit(100.0)).cast("long")), (lambda p: F.floor(p * high / F.lit(100.0)).cast("long"))
        window = F.transform(F.col("windows")[0]["best"], lambda b: F.struct(b["row"].alias("pid"), F.lit(0).alias("own"), bottom(b["score"]).alias("low"), top(b["score"]).alias("high"), empty.alias("best")))
        n = a.withColumn("windows", F.filter(window, lambda w: w["low"] <= w["high"])).withColumn("visited", F.lit(0))
        n = n.filter(F.size("windows") > 0)
        if not n.isEmpty():
            mined = certified(table(n, "negatives"), placed, directory, shared, negatives, shards, first, report)
            mined = mined.select("row", F.explode("windows").alias("w")).select("row", F.col("w.pid").alias("pid"), F.posexplode("w.best").alias("at", "b"))
            good = a.select("row", F.col("vec_id").alias("anchor_id"), F.explode(F.col("windows")[0]["best"]).alias("p"))
            good = good.select("row", "anchor_id", F.col("p.row").alias("pid"), F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
            parts.append(good.join(mined, ["row", "pid"]))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("negative_id"), "positive_score", F.col("b.score").alias("negative_score"))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE)::BIGINT for x in embedding]::DOUBLE[] AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS own, list_dot_product(a.v, c.v)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.own AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op12_multi_index_negatives", SQL)
def multi_index_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").filter(finite("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return hard_negatives(e.select("vec_id", label.cast("int").alias("label"), v.alias("v")), F.col("vec_id") % 100 == 0)
