"""Low-rank factorization and completion of performance tables.

Tables stay long. The exact method brings one m x m second-moment matrix of the shorter
side, the configurations as a rule, to the driver. Where that is too long a side, the caller
chooses the randomized range finder, which keeps everything but l x l matrices distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfgrid.session import broadcast_checked, cut, partitions


def gram(vectors: DataFrame, m: int, x: str = "x") -> DataFrame:
    """(i, j, value), i <= j: second moments of array rows.

    Each task adds up one m x m partial; only partials are shuffled. Rows whose
    vectors are sparse come as ``map<int,double>`` and are densified per batch.
    """
    sparse = vectors.schema[x].dataType.typeName() == "map"
    upper = np.triu_indices(m)

    def partial(batches):
        total = np.zeros((m, m))
        for b in batches:
            for start in range(0, len(b), 512):
                part = b[x].iloc[start : start + 512]
                if sparse:
                    a = np.zeros((len(part), m))
                    for r, entries in enumerate(part):
                        items = entries.items() if isinstance(entries, dict) else entries
                        for i, v in items:
                            a[r, i] = v
                else:
                    a = np.array(part.tolist(), float)
                total += a.T @ a
        yield pd.DataFrame({"i": upper[0].astype("int32"), "j": upper[1].astype("int32"), "value": total[upper]})

    tasks = vectors.select(x).coalesce(max(1, partitions(vectors.sparkSession)))
    return tasks.mapInPandas(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def gram_matrix(vectors: DataFrame, m: int, x: str = "x") -> np.ndarray:
    """The second-moment matrix on the driver, m x m."""
    out = np.zeros((m, m))
    for r in gram(vectors, m, x).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"]
    return out


@dataclass
class Factors:
    """sigma descending; rows (id, x = u sigma), columns (id, y = v) as tables."""

    sigma: np.ndarray
    all_sigma: np.ndarray | None
    rows: DataFrame
    cols: DataFrame

    @property
    def rank(self) -> int:
        return len(self.sigma)


def _eigen(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and vectors from second moments, largest first, sign fixed by
    making each vector's largest entry positive."""
    w, v = np.linalg.eigh(g)
    w, v = np.maximum(w[::-1], 0.0), v[:, ::-1]
    lead = np.abs(v).round(9).argmax(0)
    return np.sqrt(w), v * np.sign(v[lead, np.arange(v.shape[1])])


def approx_rank(sigma: np.ndarray, threshold: float = 0.03) -> int:
    """Number of singular values not below threshold x the largest."""
    return int((sigma >= threshold * sigma[0]).sum())


def _axis(coo: DataFrame, key: str) -> list:
    """Sorted ids of the shorter axis."""
    return sorted(r[0] for r in coo.select(key).distinct().collect())


def _side(coo: DataFrame, short: str, long: str, value: str, ids: list) -> np.ndarray:
    spark = coo.sparkSession
    id_type = coo.schema[short].dataType.simpleString()
    index = spark.createDataFrame([(v, i) for i, v in enumerate(ids)], f"{short} {id_type}, _i int")
    packed = coo.join(F.broadcast(index), short).groupBy(long).agg(
        F.map_from_entries(F.collect_list(F.struct("_i", F.col(value).cast("double")))).alias("x")
    )
    return gram_matrix(packed, len(ids))


def _project(coo: DataFrame, short: str, long: str, value: str, ids: list, v: np.ndarray, scale: np.ndarray, name: str) -> DataFrame:
    """(long, sum over the short side of value x vector): one map-side combined sum per component."""
    spark = coo.sparkSession
    id_type = coo.schema[short].dataType.simpleString()
    table = spark.createDataFrame([(i, [float(t) for t in row]) for i, row in zip(ids, v / scale)], f"{short} {id_type}, _v array<double>")
    sums = [F.sum(F.col(value) * F.col("_v")[r]) for r in range(v.shape[1])]
    return coo.join(F.broadcast(table), short).groupBy(long).agg(F.array(*sums).alias(name))


def factorize(
    coo: DataFrame, row: str, col: str, value: str, rank: int | None = None, threshold: float | None = None, exact: bool = True
) -> Factors:
    """Truncated SVD of a long table with zeros for absent cells: A ~ X Y with
    X = U sigma (row table) and Y = V' (column table); zero sigma are dropped.

    ``exact`` needs the square of the shorter side on the driver. Otherwise block power iteration
    gives ``rank`` components to an accuracy that grows with the gap behind them.
    """
    if (rank is None) == (threshold is None):
        raise ValueError("give either rank or threshold")
    spark = coo.sparkSession
    if not exact:
        if rank is None:
            raise ValueError("the randomized method needs a rank")
        return _range_finder(coo, row, col, value, rank)
    sides = coo.agg(F.count_distinct(row).alias("r"), F.count_distinct(col).alias("c")).first()
    on_cols = sides["c"] <= sides["r"]
    ids = _axis(coo, col if on_cols else row)
    short, long = (col, row) if on_cols else (row, col)
    sigma, v = _eigen(_side(coo, short, long, value, ids))
    k = rank if rank is not None else approx_rank(sigma, threshold)
    k = min(k, int((sigma > 1e-10 * max(sigma[0], 1e-300)).sum()))
    s, v = sigma[:k], v[:, :k]
    id_type = coo.schema[short].dataType.simpleString()
    short_scale = np.ones(k) if on_cols else s
    short_table = spark.createDataFrame(
        [(i, [float(t) for t in r]) for i, r in zip(ids, v * short_scale)], f"{short} {id_type}, {'y' if on_cols else 'x'} array<double>"
    )
    if on_cols:
        return Factors(s, sigma, _project(coo, col, row, value, ids, v, np.ones(k), "x"), short_table)
    return Factors(s, sigma, short_table, _project(coo, row, col, value, ids, v, s, "y"))


def _range_finder(coo: DataFrame, row: str, col: str, value: str, rank: int, extra: int = 8, sweeps: int = 4) -> Factors:
    """Block power iteration with random start; all sides stay tables of short arrays."""
    width = rank + extra
    start = F.array(*[(F.pmod(F.xxhash64(F.col(col), F.lit(r)), F.lit(2_000_003)) / 1_000_001.5 - 1.0) for r in range(width)])
    z = cut(coo.select(col).distinct().withColumn("_z", start))

    def apply(table: DataFrame, key: str, out: str) -> DataFrame:
        sums = [F.sum(F.col(value) * F.col("_z")[r]) for r in range(width)]
        return coo.join(table, key).groupBy(out).agg(F.array(*sums).alias("_z"))

    def whiten(table: DataFrame) -> tuple[DataFrame, np.ndarray]:
        s, v = _eigen(gram_matrix(table, width, "_z"))
        keep = s > 1e-10 * s[0]
        t = np.where(keep, 1.0 / np.where(keep, s, 1.0), 0.0) * v
        turn = [sum((F.col("_z")[i] * F.lit(float(t[i, j])) for i in range(width)), F.lit(0.0)) for j in range(width)]
        return cut(table.withColumn("_z", F.array(*turn))), s

    for _ in range(sweeps):
        q, _ = whiten(apply(z, col, row))
        z, sigma = whiten(apply(q, row, col))
    x = apply(z, col, row)  # z holds right vectors, so A z = u sigma
    cols = z.select(col, F.slice("_z", 1, rank).alias("y"))
    return Factors(sigma[:rank], None, x.select(row, F.slice("_z", 1, rank).alias("x")), cols)


def reconstruct(f: Factors, row: str, col: str) -> DataFrame:
    """Every cell of X Y, row by row; a long column table is not broadcast."""
    d = f.rows.crossJoin(broadcast_checked(cut(f.cols.select(col, "y")), 256))
    return d.select(row, col, dot("x", "y").alias("value"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda s, t: s * t), F.lit(0.0), lambda s, v: s + v)


def row_coefficients(obs: DataFrame, cols: DataFrame, rank: int, max_rank: DataFrame | None = None, key: str = "dataset_id") -> DataFrame:
    """Least-squares coefficients of many partially observed rows in one job.

    Known cells meet the column table, normal-equation sums per row are map-side
    combined, and the k x k systems are solved in batches; rows with fewer known
    cells than k get the minimum-norm solution. ``max_rank`` (key, k) uses fewer
    components for some rows.
    """
    d = obs.filter(F.col("error").isNotNull()).join(broadcast_checked(cut(cols), 256), "config_id")
    if max_rank is not None:
        d = d.join(max_rank.select(key, "k"), key)
        d = d.withColumn("y", F.transform("y", lambda v, i: F.when(i < F.col("k"), v).otherwise(0.0)))
    y = [F.col("y")[r] for r in range(rank)]
    aggs = [F.sum(y[i] * y[j]) for i in range(rank) for j in range(i, rank)] + [F.sum(v * F.col("error")) for v in y]
    sums = d.groupBy(key).agg(F.array(*aggs).alias("s"))
    upper = np.triu_indices(rank)

    def solve(batches):
        for b in batches:
            s = np.array(b["s"].tolist(), float).reshape(len(b), -1)
            g = np.zeros((len(b), rank, rank))
            g[:, upper[0], upper[1]] = g[:, upper[1], upper[0]] = s[:, : len(upper[0])]
            x = np.einsum("nij,nj->ni", np.linalg.pinv(g, rcond=1e-10, hermitian=True), s[:, len(upper[0]) :])
            yield pd.DataFrame({key: b[key], "x": x.tolist()})

    return sums.mapInPandas(solve, f"{key} {obs.schema[key].dataType.simpleString()}, x array<double>")


def complete_rows(obs: DataFrame, cols: DataFrame, rank: int, max_rank: DataFrame | None = None, key: str = "dataset_id") -> DataFrame:
    """(key, config_id, predicted) for the whole row of every partially observed dataset."""
    coef = row_coefficients(obs, cols, rank, max_rank, key)
    d = coef.crossJoin(broadcast_checked(cut(cols.select("config_id", "y")), 256))
    return d.select(key, "config_id", dot("x", "y").alias("predicted"))


def pivot_order(g: np.ndarray, k: int) -> list[int]:
    """Column-pivot order from second moments (pivoted Cholesky); ties to the first."""
    left = np.diag(g).astype(float).copy()
    low = np.zeros((k, len(g)))
    out: list[int] = []
    for r in range(min(k, len(g))):
        open_ = left.copy()
        open_[out] = -1.0
        p = int(np.flatnonzero(open_ >= open_.max() - 1e-12 * max(np.diag(g).max(), 1e-300))[0])
        if open_[p] <= 1e-12 * np.diag(g).max():
            break
        low[r] = (g[p] - low[:r, p] @ low[:r]) / np.sqrt(left[p])
        left = left - low[r] ** 2
        out.append(p)
    return out


def pivot_columns(coo: DataFrame, row: str, col: str, value: str, rank: int | None = None, threshold: float | None = None) -> DataFrame:
    """(place, col): the most independent columns of the table."""
    if (rank is None) == (threshold is None):
        raise ValueError("give either rank or threshold")
    ids = _axis(coo, col)
    if not ids:
        return coo.sparkSession.createDataFrame([], f"place bigint, {col} {coo.schema[col].dataType.simpleString()}")
    g = _side(coo, col, row, value, ids)
    k = rank if rank is not None else approx_rank(_eigen(g)[0], threshold)
    id_type = coo.schema[col].dataType.simpleString()
    return coo.sparkSession.createDataFrame([(i + 1, ids[p]) for i, p in enumerate(pivot_order(g, k))], f"place bigint, {col} {id_type}")


def pivot_latent(cols: DataFrame, k: int) -> DataFrame:
    """The same on latent columns (config_id, y) of any number: k rounds, each takes
    the largest residual and projects it out of all others in one pass."""
    d, taken = cols.withColumn("_r", F.col("y")), []
    for i in range(k):
        norm = F.round(dot("_r", "_r"), 12)
        best = d.agg(F.min_by(F.struct("config_id", "_r"), F.struct(-norm, F.col("config_id"))).alias("b")).first()["b"]
        q = np.array(best["_r"], float)
        length = float(np.linalg.norm(q))
        if length < 1e-9:
            break
        q = q / length
        unit = F.array(*[F.lit(float(v)) for v in q])
        along = dot("_r", unit)
        d = d.filter(F.col("config_id") != F.lit(best["config_id"])).withColumn("_a", along)
        d = d.withColumn("_r", F.zip_with("_r", unit, lambda a, b: a - F.col("_a") * b)).drop("_a")
        if i % 8 == 7:
            d = cut(d)
        taken.append((i + 1, best["config_id"]))
    id_type = cols.schema["config_id"].dataType.simpleString()
    return cols.sparkSession.createDataFrame(taken, f"place bigint, config_id {id_type}")


def pca_scores(vectors: DataFrame, x: str, n_components: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Centered projection on the leading components, with the axes and the mean.

    Mean and second moments come from one pass; the projection is a literal matrix
    (components x features) applied per row.
    """
    m = vectors.select(F.size(x).alias("m")).first()["m"]
    one = vectors.withColumn(x, F.concat(F.array(F.lit(1.0)), x))
    g = gram_matrix(one, m + 1, x)
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    _, v = _eigen(g[1:, 1:] - n * np.outer(mean, mean))
    axes = v[:, :n_components].T.copy()

    def project(batches):
        for b in batches:
            a = np.array(b[x].tolist(), float) - mean
            s = a @ axes.T
            b["score"] = s.tolist()
            b["rest"] = ((a - s @ axes) ** 2).sum(1)
            yield b

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInPandas(project, f"{fields}, score array<double>, rest double"), axes, mean

