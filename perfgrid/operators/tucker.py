"""Tucker decomposition and completion of sparse tensors.

A tensor is a long table (i0, i1, .., value); an absent cell is missing. The core
and the factor matrices are small and sized in advance. A sweep never lists the
missing cells: the filled tensor equals the low-rank tensor plus the residual on the
observed cells, so one pass over the observed cells and small dense products give
the exact contraction of the filled tensor.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfgrid.operators.lowrank import _eigen, approx_rank, gram_matrix
from perfgrid.session import partitions

MAX_FACTOR = 4_000_000  # numbers in all factor matrices together (32 MB), shipped to every task
MAX_CONTRACTION = 16_000_000  # numbers in one mode's contraction (128 MB), held by a task and the driver
SLICE = 2_000_000  # numbers in one product of cells and factors (16 MB); a task holds a few such products


@dataclass
class Tucker:
    core: np.ndarray
    factors: list[np.ndarray]
    errors: list[float] = field(default_factory=list)

    def dense(self) -> np.ndarray:
        """The whole tensor; for tests on small ones only."""
        out = self.core
        for m, u in enumerate(self.factors):
            out = np.moveaxis(np.tensordot(u, out, axes=(1, m)), 0, m)
        return out


def unfold(coo: DataFrame, mode: int, sizes: list[int], out: str = "j") -> DataFrame:
    """(i_mode, j, value): mode-n unfolding by index arithmetic, last index fastest."""
    rest = [m for m in range(len(sizes)) if m != mode]
    idx = F.col(f"i{rest[0]}").cast("bigint")
    for m in rest[1:]:
        idx = idx * sizes[m] + F.col(f"i{m}")
    return coo.select(f"i{mode}", idx.alias(out), "value")


def mode_product(coo: DataFrame, mode: int, matrix: DataFrame, rank: int, n_modes: int) -> DataFrame:
    """Replaces mode ``mode`` (index i) by r: sum over i of value x matrix(i, r).

    ``matrix`` is (i, w array) and is joined, so it may be of any length.
    """
    others = [f"i{m}" for m in range(n_modes) if m != mode]
    w = matrix.select(F.col("i").alias(f"i{mode}"), "w")
    sums = coo.join(w, f"i{mode}").groupBy(*others).agg(F.array(*[F.sum(F.col("value") * F.col("w")[r]) for r in range(rank)]).alias("s"))
    return sums.select(*others, F.posexplode("s").alias(f"i{mode}", "value")).select(*[f"i{m}" for m in range(n_modes)], "value")


def _check(sizes: list[int], ranks: list[int]) -> None:
    """Factor matrices are shipped to tasks and contractions summed per task: both
    are sized before any job starts."""
    if sum(n * r for n, r in zip(sizes, ranks)) > MAX_FACTOR:
        raise ValueError("factor matrices exceed the shipping bound; split the longest mode or lower its rank")
    core = int(np.prod(ranks))
    if max(n * core // r for n, r in zip(sizes, ranks) if r < n or n == max(sizes)) > MAX_CONTRACTION:
        raise ValueError("a contraction exceeds the task bound; split the longest mode or lower the ranks")


def _values(pdf: pd.DataFrame, n_modes: int, t: Tucker | None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Indices, observed values and residuals of a batch."""
    idx = [pdf[f"i{m}"].to_numpy() for m in range(n_modes)]
    v = pdf["value"].to_numpy(float)
    if t is None:
        return idx, v, v
    return idx, v, v - predict_cells(t, idx)


def predict_cells(t: Tucker, idx: list[np.ndarray]) -> np.ndarray:
    """Low-rank values of the listed cells, as many at once as keep a product at ``SLICE`` numbers."""
    step = max(1, SLICE // max(1, t.core.size // t.core.shape[0]))
    if len(idx[0]) > step:
        return np.concatenate([predict_cells(t, [i[a : a + step] for i in idx]) for a in range(0, len(idx[0]), step)])
    out = np.broadcast_to(t.core.reshape(1, -1), (len(idx[0]), t.core.size))
    shape = list(t.core.shape)
    for m in range(len(idx)):
        out = np.einsum("br,brk->bk", t.factors[m][idx[m]], out.reshape(len(out), shape[m], -1))
    return out[:, 0]


def _add_cells(totals: list[np.ndarray], pdf: pd.DataFrame, modes: list[int | None], factors: list[np.ndarray], t: Tucker | None) -> float:
    """Adds the cells of a batch to the contraction of each listed mode; gives their squared residual norm.

    As many cells are taken at once as keep their widest product at ``SLICE`` numbers: at high ranks that is as
    wide as the whole core."""
    n_modes, norm = len(factors), 0.0
    before = np.cumprod([1, *(f.shape[1] for f in factors)])
    widest = max(int(before[-1 if mode is None else mode]) * (1 if mode is None else int(before[-1] // before[mode + 1])) for mode in modes)
    step = max(1, min(4096, SLICE // max(1, widest)))
    last = max(n_modes if mode is None else mode for mode in modes)
    first = min(n_modes if mode is None else mode + 1 for mode in modes)
    beside = lambda a, b: (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)
    for s in range(0, len(pdf), step):
        part = pdf.iloc[s : s + step]
        idx, _, e = _values(part, n_modes, t)
        norm += float(e @ e)
        looked = [f[i] for f, i in zip(factors, idx)]
        upto, after = [e[:, None]], {n_modes: np.ones((len(part), 1))}
        for m in range(last):
            upto.append(beside(upto[-1], looked[m]))
        for m in range(n_modes - 1, first - 1, -1):
            after[m] = beside(looked[m], after[m + 1])
        for total, mode in zip(totals, modes):
            if mode is None:
                total[0] += upto[-1].sum(0)
            else:
                np.add.at(total, idx[mode], beside(upto[mode], after[mode + 1]))
    return norm


def _scan(coo: DataFrame, sizes: list[int], modes: list[int | None], factors: list[np.ndarray], t: Tucker | None) -> tuple[list[np.ndarray], float]:
    """One scan of the observed cells: for each listed mode the contraction of the (residual) cells with the
    factors of all other modes (None: of all modes), and the squared residual norm.

    Contractions of the modes before and after a mode are shared by all modes. A task adds up one array of
    sizes[mode] x product(other ranks) for each; their partials are summed by Spark before the driver sees them.
    """
    n_modes = len(sizes)
    widths = [int(np.prod([factors[m].shape[1] for m in range(n_modes) if m != mode])) for mode in modes]
    rows = [1 if mode is None else sizes[mode] for mode in modes]

    def partial(batches):
        totals, norm = [np.zeros((r, w)) for r, w in zip(rows, widths)], 0.0
        for pdf in batches:
            norm += _add_cells(totals, pdf, modes, factors, t)
        for k, total in enumerate(totals):
            hit = np.flatnonzero(np.abs(total).sum(1))
            yield pd.DataFrame({"k": np.full(len(hit), k, "int32"), "i": hit.astype("int32"), "w": list(total[hit])})
        yield pd.DataFrame({"k": np.array([-1], "int32"), "i": np.array([0], "int32"), "w": [np.array([norm])]})

    parts = coo.coalesce(max(1, partitions(coo.sparkSession))).mapInPandas(partial, "k int, i int, w array<double>")
    sums = parts.select("k", "i", F.posexplode("w").alias("j", "v")).groupBy("k", "i", "j").agg(F.sum("v").alias("v"))
    packed = sums.groupBy("k", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("w"))
    out, norm = [np.zeros((r, w)) for r, w in zip(rows, widths)], 0.0
    for r in packed.collect():
        w = [x["v"] for x in r["w"]]
        if r["k"] < 0:
            norm = w[0]
        else:
            out[r["k"]][r["i"]] = w
    return out, norm


def _pass(coo: DataFrame, sizes: list[int], mode: int | None, factors: list[np.ndarray], t: Tucker | None) -> tuple[np.ndarray, float]:
    """The same for one mode."""
    (z,), norm = _scan(coo, sizes, [mode], factors, t)
    return z, norm


def _low_rank_part(t: Tucker, mode: int | None, factors: list[np.ndarray]) -> np.ndarray:
    """Contraction of the low-rank tensor itself: products of small matrices only."""
    out = t.core
    for m in range(out.ndim):
        if m != mode:
            out = np.moveaxis(np.tensordot(factors[m].T @ t.factors[m], out, axes=(1, m)), 0, m)
    if mode is None:
        return out.reshape(1, -1)
    return np.tensordot(t.factors[mode], out, axes=(1, mode)).reshape(t.factors[mode].shape[0], -1)


def _contract(coo, sizes, mode, factors, t):
    z, norm = _pass(coo, sizes, mode, factors, t)
    return (z if t is None else z + _low_rank_part(t, mode, factors)), norm


def _lead(z: np.ndarray, rank: int) -> np.ndarray:
    """Leading left vectors of a contraction, through the smaller second moment."""
    if z.shape[1] <= z.shape[0]:
        s, v = _eigen(z.T @ z)
        keep = s[:rank] > 1e-10 * max(s[0], 1e-300)
        u = z @ v[:, :rank] / np.where(keep, s[:rank], 1.0)
        q, r = np.linalg.qr(u)
        return q * np.where(np.diag(r) < 0, -1.0, 1.0)
    return _eigen(z @ z.T)[1][:, :rank]


def mode_moment(coo: DataFrame, mode: int, sizes: list[int]) -> np.ndarray:
    """Second moments of a mode's unfolding; fibres are gathered by
    the other indices, so no pairs of cells are ever listed; the moments are n x n on the driver."""
    j = unfold(coo, mode, sizes)
    fibres = j.groupBy("j").agg(F.map_from_entries(F.collect_list(F.struct(F.col(f"i{mode}").cast("int"), "value"))).alias("x"))
    return gram_matrix(fibres, sizes[mode])


def hosvd_factors(coo: DataFrame, sizes: list[int], ranks: list[int], random_modes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Start: leading vectors of every mode. ``random_modes``, chosen by the caller for modes whose moments the
    driver cannot hold, start from a seeded random orthonormal matrix and are settled by the sweeps."""
    out = []
    for m, r in enumerate(ranks):
        if r >= sizes[m]:
            out.append(np.eye(sizes[m])[:, :r])
        elif m not in random_modes:
            out.append(_eigen(mode_moment(coo, m, sizes))[1][:, :r])
        else:
            out.append(np.linalg.qr(np.random.default_rng(m).standard_normal((sizes[m], r)))[0])
    return out


def sweep(coo: DataFrame, sizes: list[int], ranks: list[int], factors: list[np.ndarray], t: Tucker | None) -> Tucker:
    """One alternating sweep on the filled tensor, then its core. Modes kept at full
    size need no update: any orthonormal basis spans them."""
    factors = list(factors)
    for m, r in enumerate(ranks):
        if r < sizes[m]:
            factors[m] = _lead(_contract(coo, sizes, m, factors, t)[0], r)
    core, _ = _contract(coo, sizes, None, factors, t)
    return Tucker(core.reshape([f.shape[1] for f in factors]), factors)


def decompose(coo: DataFrame, sizes: list[int], ranks: list[int], sweeps: int = 2, random_modes: tuple[int, ...] = ()) -> Tucker:
    """Tucker decomposition with absent cells as zeros: HOSVD start, then sweeps."""
    ranks = [min(r, n) for r, n in zip(ranks, sizes)]
    _check(sizes, ranks)
    factors = hosvd_factors(coo, sizes, ranks, random_modes)
    t = None
    for _ in range(max(1, sweeps)):
        t = sweep(coo, sizes, ranks, factors, None)
        factors = t.factors
    return t


def observed_error(coo: DataFrame, sizes: list[int], t: Tucker) -> float:
    """Norm of the residual on the observed cells."""
    return float(np.sqrt(_pass(coo, sizes, None, [np.ones((n, 1)) for n in sizes], t)[1]))


def complete(
    coo: DataFrame, sizes: list[int], ranks: list[int], max_sweeps: int = 1000, tolerance: float = 1e-4, mean_fill: bool = False
) -> Tucker:
    """Completion by filling: start with zeros (or the mean) in the missing cells,
    decompose, refill them from the model, and so on. Stops when, after two rounds,
    the observed error gains less than the tolerance. Observed cells never change.

    A round is two scans: one contracts for all modes at once, with the factors of the round
    before, and gives that round's error as well; one gives the core. A round that would raise the
    observed error is taken back and done again one mode after the other.
    """
    ranks = [min(r, n) for r, n in zip(ranks, sizes)]
    _check(sizes, ranks)
    coo = coo.persist()
    factors = hosvd_factors(coo, sizes, ranks)
    t = None
    if mean_fill:
        mean = float(coo.agg(F.avg("value")).first()[0])
        t = Tucker(np.full([1] * len(sizes), mean), [np.ones((n, 1)) for n in sizes])
    open_modes = [m for m, r in enumerate(ranks) if r < sizes[m]]
    errors: list[float] = []
    kept, together = None, True
    while True:
        zs, norm = _scan(coo, sizes, open_modes or [None], factors, t)
        if kept is not None or errors:
            error = float(np.sqrt(norm))
            if errors and together and error > errors[-1] * (1 + 1e-12):  # taken back
                together = False
                t = sweep(coo, sizes, ranks, kept.factors, kept)
                factors = t.factors
                continue
            errors.append(error)
            gained = len(errors) <= 2 or (errors[-2] - errors[-1]) / errors[-2] >= tolerance
            if not gained or len(errors) >= max_sweeps or error < 1e-12:
                break
        kept, together, before = t or Tucker(np.zeros([1] * len(sizes)), [np.zeros((n, 1)) for n in sizes]), True, factors
        factors = list(before)
        for m, z in zip(open_modes, zs):
            factors[m] = _lead(z if t is None else z + _low_rank_part(t, m, before), ranks[m])
        core, _ = _contract(coo, sizes, None, factors, t)
        t = Tucker(core.reshape([f.shape[1] for f in factors]), factors)
    t.errors = errors
    coo.unpersist()
    return t


def fill(coo: DataFrame, sizes: list[int], t: Tucker) -> DataFrame:
    """Completed table: observed cells as they are, missing ones from the model."""
    n_modes = len(sizes)
    keys = [f"i{m}" for m in range(n_modes)]
    grid = coo.sparkSession.range(sizes[0]).select(F.col("id").cast("int").alias("i0"))
    for m in range(1, n_modes):
        grid = grid.withColumn(f"i{m}", F.explode(F.sequence(F.lit(0), F.lit(sizes[m] - 1))))
    full = grid.join(coo.select(*keys, F.col("value").alias("seen")), keys, "left")

    def model(batches):
        for b in batches:
            b["model"] = predict_cells(t, [b[k].to_numpy() for k in keys])
            yield b

    typed = ", ".join(f"{k} int" for k in keys)
    out = full.mapInPandas(model, f"{typed}, seen double, model double")
    return out.select(*keys, F.coalesce("seen", "model").alias("value"), F.col("seen").isNotNull().alias("observed"))


def tensor_rank(coo: DataFrame, sizes: list[int], modes: list[int], threshold: float = 0.03) -> list[int]:
    """Approximate rank of the listed modes; the others stay at full size."""
    return [approx_rank(_eigen(mode_moment(coo, m, sizes))[0], threshold) if m in modes else n for m, n in enumerate(sizes)]


def latent_configs(spark, t: Tucker, sizes: list[int], rank: int) -> tuple[np.ndarray, DataFrame]:
    """Latent factors of all configurations (modes 1..): SVD of the low-rank tensor's
    first unfolding. Because the first factor has orthonormal columns, only the small
    core has to be decomposed; the config table is built by Spark.
    """
    u0 = t.factors[0]
    ortho, tri = np.linalg.qr(u0)
    grams = [f.T @ f for f in t.factors[1:]]
    first = np.tensordot(tri, t.core, axes=(1, 0))
    weighted = first
    for m, g in enumerate(grams, start=1):
        weighted = np.moveaxis(np.tensordot(g, weighted, axes=(1, m)), 0, m)
    flat = first.reshape(first.shape[0], -1)
    s, u = _eigen(flat @ weighted.reshape(first.shape[0], -1).T)
    k = min(rank, int((s > 1e-10 * s[0]).sum()))
    small = (u[:, :k] / s[:k]).T @ flat
    small = small.reshape([k, *first.shape[1:]])
    rest = sizes[1:]
    grid = spark.range(int(np.prod(rest))).select(F.col("id").alias("config_id"))

    def build(batches):
        for b in batches:
            idx, left = [], b["config_id"].to_numpy()
            for n in rest[::-1]:
                idx.append(left % n)
                left = left // n
            idx = idx[::-1]
            y = np.empty((len(b), k))
            for r in range(k):
                y[:, r] = predict_cells(Tucker(small[r], t.factors[1:]), idx)
            yield pd.DataFrame({"config_id": b["config_id"], "y": y.tolist()})

    return s[:k], grid.mapInPandas(build, "config_id bigint, y array<double>")

