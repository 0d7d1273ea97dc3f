"""Labelled rows of many datasets as numeric blocks, and rounds of additive statistics over them.

A block holds a bounded number of rows of one dataset: feature values, label codes, folds and
row hashes as plain numbers. A dataset of any size is as many blocks as it needs, dealt by row
hash, so one that holds most rows is spread like all others.

Learners train in rounds (:func:`train`). In a round every block meets the open models of its dataset and
gives each an additive statistic (sums, histograms); statistics are added inside a partition, then by a
shuffle on the model, and turn its state into the next one. Models that are settled leave the
rounds. Where a few blocks are the whole dataset, one task holds them beside a pack of its models, adds their
statistics itself, and the rounds follow each other inside the task: many small datasets cost one pass.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from perfgrid.operators import gnb, prep
from perfgrid.session import attach, broadcast_checked, cut, partitions

BLOCK_ROWS, BLOCK_BYTES, BINS, PACK = 32_768, 32 << 20, 255, 16
FLUSH_BYTES = 64 << 20  # statistics a task holds before it passes them on
MODEL_BYTES = 32 << 20  # models that go to every executor
WHOLE_BYTES = 16 << 20  # a dataset of fewer bytes is trained on by one task for each of its packs of models
WHOLE_PACKS = 16  # packs of models such a dataset is sent to, at most
INFO = ["imputer", "standardize", "classes", "counts", "fill", "shift", "sd", "edges"]


@dataclass
class Blocks:
    """``frame``: written blocks; ``info``: what is known of each (dataset, left-out fold, imputer)."""

    frame: DataFrame
    info: DataFrame
    dataset: list[str]
    cols: list[str]
    ids: list[str]
    count: int | None = None
    block_rows: int = BLOCK_ROWS

    def whole(self) -> int:
        """Number of blocks up to which one task holds a dataset."""
        return max(1, WHOLE_BYTES // (self.block_rows * (8 * len(self.cols) + 13)))

    def many(self) -> bool:
        """Whether there are enough blocks for all tasks, wherever they lie."""
        if self.count is None:
            self.count = self.frame.count()
        return self.count >= 4 * partitions(self.frame.sparkSession)


class Data:
    """One block as arrays; ``y`` is -1 where the label is unknown."""

    def __init__(self, row: dict, dims: int):
        self.y, self.fold = np.frombuffer(row["y"], np.int32), np.frombuffer(row["fold"], np.int8)
        self.x = np.frombuffer(_wide(row["x"], 8 * dims * len(self.y)), np.float64).reshape(len(self.y), dims)
        self.key = np.frombuffer(row["key"], np.int64)
        self.gaps, self.held = bool(np.isnan(self.x).any()), {}

    def remember(self, name, make: Callable):
        """Something computed once for this block."""
        if name not in self.held:
            self.held[name] = make()
        return self.held[name]

    def forget(self) -> None:
        """Drops what belongs to one model only."""
        self.held = {n: v for n, v in self.held.items() if n[0] in ("filled", "scaled", "codes")}

    def leave(self) -> None:
        """Drops what belongs to one preparation only."""
        self.held = {n: v for n, v in self.held.items() if n[:2] == ("codes", None)}

    @staticmethod
    def way(info: dict) -> tuple:
        return _way(info)

    def nodes(self, tree, info: dict, place: int = 0) -> np.ndarray:
        """Node of each row. A tree that has grown since it was last asked for moves the rows of split nodes only;
        ``place`` tells trees apart that grow side by side."""
        last, node = self.held.get(("nodes", place), (None, None))
        node = tree.route(self.filled(info), node if last is tree else None)
        self.held["nodes", place] = (tree, node)
        return node

    def filled(self, info: dict) -> np.ndarray:
        if not self.gaps:
            return self.x
        return self.remember(("filled", *_way(info)), lambda: np.where(np.isnan(self.x), np.array(info["fill"]), self.x))

    def scaled(self, info: dict) -> np.ndarray:
        """Filled and, if wanted, standardized features behind a column of ones."""

        def make():
            z = self.filled(info)
            z = (z - np.array(info["shift"])) / np.array(info["sd"]) if info["standardize"] else z
            return np.concatenate([np.ones((len(z), 1)), z], axis=1)

        return self.remember(("scaled", *_way(info)), make)

    def binned(self, info: dict) -> tuple:
        """Name of the bins: rows without missing values have the same ones wherever the edges are the same."""
        return "codes", _way(info) if self.gaps else None, tuple(map(tuple, info["edges"]))

    def codes(self, info: dict) -> np.ndarray:
        """Bin of each filled value: the first edge that is not below it."""

        def make():
            x = self.filled(info)
            out = np.zeros(x.shape[::-1], np.int64)
            for f, e in enumerate(info["edges"]):
                out[f] = np.minimum(np.searchsorted(e, np.ascontiguousarray(x[:, f]), "left"), max(0, len(e) - 1))
            return out.T

        return self.remember(self.binned(info), make)

    def training(self, info: dict) -> np.ndarray:
        return (self.fold != info["outer"]) & (self.y >= 0)


def block_stats(frame: DataFrame, dataset: list[str], cols: list[str], k: int | None, bins: int | None) -> DataFrame:
    """Statistics of each block, from one pass over the blocks: lines (dataset, code, fold, feature, n_all, n, mean, var) of the
    rows of a label code (NULL: no label) and fold, with one line without a feature, and lines (dataset, feature, values)
    with the distinct known values of a feature in the block, NULL where they are more than ``bins``."""
    dims = len(cols)
    schema = StructType([frame.schema[n] for n in dataset])
    for n, t in (("code", IntegerType()), ("fold", IntegerType()), ("feature", StringType()), ("n_all", LongType()), ("n", LongType()), ("mean", DoubleType()), ("var", DoubleType()), ("listed", BooleanType()), ("values", ArrayType(DoubleType()))):
        schema = schema.add(n, t)
    arrow = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.float64())]

    def lines_of(data: Data) -> Iterator[tuple]:
        fold = data.fold.astype(np.int64) if k else np.zeros(len(data.y), np.int64)
        cell = (data.y.astype(np.int64) + 1) * 256 + fold + 128
        every = np.bincount(cell)
        there = np.flatnonzero(every)
        at = np.zeros(len(every), np.int64)
        at[there] = np.arange(len(there))
        at, n_all = at[cell], every[there].tolist()
        keys = [(c - 1 if c else None, f - 128) for c, f in (divmod(int(i), 256) for i in there)]
        yield from ((*key, None, n, None, None, None, False, None) for key, n in zip(keys, n_all))
        for j, name in enumerate(cols):
            v, place = np.ascontiguousarray(data.x[:, j]), at
            known = ~np.isnan(v)
            if not known.all():
                v, place = v[known], at[known]
            n = np.bincount(place, minlength=len(there))
            with np.errstate(invalid="ignore", over="ignore"):
                mean = np.bincount(place, weights=v, minlength=len(there)) / np.maximum(n, 1)
                gap = v - mean[place]
                var = np.bincount(place, weights=gap * gap, minlength=len(there)) / np.maximum(n, 1)
            some = (n > 0).tolist()
            yield from ((*key, name, a, b, m if ok else None, w if ok else None, False, None) for key, a, b, m, w, ok in zip(keys, n_all, n.tolist(), mean.tolist(), var.tolist(), some))
            if bins is not None and len(v):
                values = np.unique(v + 0.0)  # zeros have no sign
                yield None, None, name, None, None, None, None, True, values.tolist() if len(values) <= bins else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {f.name: f.type for f in batch.schema}
            for row, data in _rows(iter([batch]), dims):
                lines = [*zip(*lines_of(data))]
                same = [pa.array([row[n]] * len(lines[0]), of[n]) for n in dataset]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array(c, t) for c, t in zip(lines, arrow)]], schema.names)

    found = frame.select(*dataset, "x", "y", "fold", "key").mapInArrow(each, schema)
    return cut(found)


def feature_edges(rows: DataFrame, stats: DataFrame, dataset: list[str], cols: list[str], bins: int = BINS) -> DataFrame:
    """(dataset, edges): upper edges of the bins of each feature, ascending. All distinct values where there
    are at most ``bins``, else quantiles of a mergeable sketch of the rows. ``stats`` are those of the blocks."""
    keys, listed = [*dataset, "feature"], stats.filter("listed")
    counted = listed.groupBy(*keys).agg(F.bool_and(F.col("values").isNotNull()).alias("_few"))
    single = listed.filter("values IS NOT NULL").select(*keys, F.explode("values").alias("value"))
    single = single.join(counted.filter("_few").select(*keys), keys, "left_semi").distinct()
    exact = cut(single.groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("_v")))
    many = counted.join(exact.filter(F.size("_v") <= bins), keys, "left_anti")
    wanted = {r[0] for r in many.select("feature").distinct().collect()}  # some of the columns
    both = counted.select(*keys).join(exact, keys, "left")
    if wanted:
        grid = F.array(*[F.lit((i + 1) / bins) for i in range(bins)])
        known = {c: F.col(c).cast("double") for c in cols if c in wanted}
        aggs = [F.percentile_approx(F.when(~F.isnan(v), v), grid, 20_000).alias(f"_a{i}") for i, v in enumerate(known.values())]
        each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_a{i}").alias("_q")) for i, c in enumerate(known)])
        sketch = rows.groupBy(*dataset).agg(*aggs).select(*dataset, F.explode(each).alias("_e")).select(*dataset, "_e.feature", "_e._q")
        both = both.join(sketch, keys, "left")
    else:
        both = both.withColumn("_q", F.col("_v"))
    use = F.when(F.col("_v").isNotNull() & (F.size("_v") <= bins), F.col("_v")).otherwise(F.array_sort(F.array_distinct("_q")))
    per = both.select(*dataset, "feature", use.alias("e")).groupBy(*dataset).agg(F.map_from_entries(F.collect_list(F.struct("feature", "e"))).alias("_m"))
    none = F.array().cast("array<double>")
    return per.select(*dataset, F.array(*[F.coalesce(F.element_at("_m", F.lit(c)), none) for c in cols]).alias("edges"))


def training_moments(stats: DataFrame, dataset: list[str], k: int | None) -> DataFrame:
    """Moments of the training rows of every left-out fold and of all rows (outer -1), from those of the blocks; the label is
    its code."""
    keys = [*dataset, "label"]
    parts = stats.filter("feature IS NOT NULL AND NOT listed").select(*dataset, F.col("code").alias("label"), "fold", "feature", "n_all", "n", "mean", "var")
    if not k:
        return cut(prep.pool(parts.drop("fold"), [*keys, "feature"]).withColumn("outer", F.lit(gnb.WHOLE)))
    folds = cut(prep.pool(parts, [*keys, "fold", "feature"]))
    whole = prep.pool(folds.drop("fold"), [*keys, "feature"]).withColumn("outer", F.lit(gnb.WHOLE))
    return cut(whole.unionByName(prep.leave_out(folds, [*keys, "feature"], k)))


def filled_stats(rows: DataFrame, stats: DataFrame, dataset: list[str], cols: list[str], k: int | None, imputer: str) -> DataFrame:
    """(dataset, outer, feature, fill, shift, sd) of the training rows of every left-out fold and of all rows (-1)."""
    fills = None
    if imputer != "mean":
        fills = prep.fill_values(rows, dataset, cols, imputer).withColumn("outer", F.lit(gnb.WHOLE))
        if k:
            from perfgrid.operators.cv import train_fills

            fills = fills.unionByName(train_fills(rows, dataset, cols, imputer, k).select(*fills.columns))
        fills = cut(fills)
    return gnb.scaled(gnb.with_fill(stats, dataset, fills), dataset, True).filter("label IS NOT NULL")


def training_info(rows: DataFrame, frame: DataFrame, names: DataFrame, dataset: list[str], cols: list[str], k: int | None, bins: int = BINS, imputers: list[str] = ("mean",), edges: bool = True) -> DataFrame:
    """(dataset, outer, imputer) with class labels, training counts, fill, shift and deviation of each feature and
    the bin edges (none without ``edges``, for learners that use no bins), from the blocks of ``frame``; ``names`` are the class labels
    of each dataset. ``outer`` -1 stands for all rows. The fill of a feature with missing values is an edge of it, so that
    filled rows are counted where they are routed."""
    stats = block_stats(frame, dataset, cols, k, bins if edges else None)
    n = stats.filter("feature IS NULL AND code IS NOT NULL").groupBy(*dataset, "code", "fold").agg(F.sum("n_all").alias("_n"))
    outer = F.explode(F.sequence(F.lit(-1), F.lit(k - 1))) if k else F.explode(F.array(F.lit(-1)))
    left = n.withColumn("outer", outer)
    left = left.filter((F.col("fold") != F.col("outer")) | (F.col("outer") < 0)) if k else left
    counts = left.groupBy(*dataset, "outer", "code").agg(F.sum("_n").alias("_n"))
    counts = counts.groupBy(*dataset, "outer").agg(F.map_from_entries(F.collect_list(F.struct("code", "_n"))).alias("_c"))
    part, moments = None, training_moments(stats, dataset, k)
    for imputer in imputers:
        q = filled_stats(rows, moments, dataset, cols, k, imputer).groupBy(*dataset, "outer").agg(F.collect_set(F.struct("feature", "fill", "shift", "sd")).alias("_q"))
        q = q.withColumn("imputer", F.lit(imputer))
        part = q if part is None else part.unionByName(q)
    every = F.explode(F.array(*[F.lit(i) for i in imputers]))
    out = names.join(counts, dataset).withColumn("imputer", every).join(part, [*dataset, "outer", "imputer"], "left")
    if edges:
        gaps = stats.filter("n < n_all").groupBy(*dataset).agg(F.collect_set("feature").alias("_gaps"))
        out = out.join(feature_edges(rows, stats, dataset, cols, bins), dataset, "left").join(gaps, dataset, "left")
    else:
        out = out.withColumn("edges", F.lit(None).cast("array<array<double>>"))
    zero, one = (F.array(*[F.lit(v)] * len(cols)).cast("array<double>") for v in (0.0, 1.0))
    arrays = {f: F.coalesce(gnb.aligned(F.col("_q"), cols, f, 1.0 if f == "sd" else 0.0), one if f == "sd" else zero) for f in ("fill", "shift", "sd")}
    none = F.array(*[F.array().cast("array<double>")] * len(cols)).cast("array<array<double>>")
    of_class = F.transform("classes", lambda c, i: F.coalesce(F.element_at("_c", i), F.lit(0)).cast("long"))
    more = [F.coalesce(F.array(*[F.coalesce(F.array_contains("_gaps", c), F.lit(False)) for c in cols]), F.array().cast("array<boolean>")).alias("_gap")] if edges else []
    out = out.select(*dataset, "outer", "imputer", "classes", of_class.alias("counts"), *[c.alias(f) for f, c in arrays.items()], F.coalesce("edges", none).alias("edges"), *more)
    if not edges:
        return out
    both = F.transform(F.arrays_zip(F.col("edges").alias("e"), F.col("fill").alias("fill"), F.col("_gap").alias("gap")), lambda z: F.when(z["gap"] & (F.size(z["e"]) < bins - 1), F.array_sort(F.array_distinct(F.array_append(z["e"], z["fill"])))).otherwise(z["e"]))
    return out.withColumn("edges", both).drop("_gap")


def _labels(rows: DataFrame, dataset: list[str], label: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(dataset, classes) and (dataset, blocks) from one count."""
    n = cut(rows.groupBy(*dataset, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("_n")))
    names = n.filter("label IS NOT NULL").groupBy(*dataset).agg(F.array_sort(F.collect_set("label")).alias("classes"))
    return names, n.groupBy(*dataset).agg(F.ceil(F.sum("_n") / size).cast("int").alias("blocks"))


def _block_rows(cols: list[str], block_rows: int) -> int:
    return max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, len(cols)))))


def _code(label: str) -> Column:
    return F.coalesce(F.array_position("classes", F.col(label)) - 1, F.lit(-1)).cast("int")


def _values(cols: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_x{i}") for i, c in enumerate(cols)]


def _narrow(raw: bytes) -> bytes:
    """Feature values as they are written and shuffled: compressed where that makes them smaller."""
    small = pa.compress(raw, codec="zstd", asbytes=True)
    return small if len(small) < len(raw) else raw


def _wide(stored: bytes, size: int) -> bytes:
    return stored if len(stored) == size else pa.decompress(stored, decompressed_size=size, codec="zstd", asbytes=True)


def _arrays(t: pa.Table, order: np.ndarray, dims: int, key: np.ndarray, fold: np.ndarray) -> dict[str, pa.Array]:
    """The arrays of a block; ``key`` and ``fold`` are in order already."""
    x = np.empty((t.num_rows, dims))
    for i in range(dims):
        x[:, i] = t.column(f"_x{i}").to_numpy()[order]
    parts = (("y", t.column("_y").to_numpy()[order].astype(np.int32)), ("fold", fold.astype(np.int8)), ("key", key.astype(np.int64)))
    out = {n: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for n, v in parts}
    return {"x": pa.array([_narrow(x.tobytes())], pa.binary()), **out}


def pack(rows: DataFrame, dataset: list[str], label: str, cols: list[str], key: Column, k: int | None = 5, ids: list[str] = (), block_rows: int = BLOCK_ROWS, bins: int = BINS, imputers: list[str] = ("mean",), info: DataFrame | None = None, edges: bool = True) -> Blocks:
    """Blocks of rows with a ``fold`` column (any fold if ``k`` is None). ``key`` is a long hash of the row; ``ids`` are
    columns that row-level predictions will carry. New rows for models of other blocks take the ``info`` of these;
    they belong to no fold."""
    rows = rows.withColumn("_key", key)
    rows = rows if "fold" in rows.columns else rows.withColumn("fold", F.lit(0 if info is None else -2))
    size = _block_rows(cols, block_rows)
    names, sizes = _labels(rows, dataset, label, size)
    names = names if info is None else info.filter("outer = -1").select(*dataset, "classes").distinct()
    d = attach(rows, sizes.join(names, dataset), dataset, 256)
    d = d.withColumn("block", F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int"))
    d = d.select(*dataset, "block", "blocks", _code(label).alias("_y"), F.col("fold").cast("byte").alias("_fold"), "_key", *_values(cols), *[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)])
    keep = [f for f in d.schema.fields if f.name in (*dataset, "block", "blocks")]
    id_types = [StructField(f"id{i}", d.schema[f"_id{i}"].dataType) for i in range(len(ids))]
    schema = StructType(keep + [StructField(n, BinaryType()) for n in ("x", "y", "fold", "key")])
    for f in id_types:
        schema = schema.add(f.name, ArrayType(f.dataType))
    dims = len(cols)

    def build(t: pa.Table) -> pa.Table:
        key = t.column("_key").to_numpy()
        order = np.argsort(key, kind="stable")
        out = {f.name: t.column(f.name).slice(0, 1) for f in keep}
        out.update(_arrays(t, order, dims, key[order], t.column("_fold").to_numpy()[order]))
        for i in range(len(id_types)):
            c = t.column(f"_id{i}").take(pa.array(order))
            out[f"id{i}"] = pa.array([c.to_pylist()], pa.list_(c.type))
        return pa.table(out)

    frame = cut(d.groupBy(*dataset, "block", "blocks").applyInArrow(build, schema), wide=True)
    info = cut(training_info(rows, frame, names, dataset, cols, k, bins, imputers, edges)) if info is None else info
    return Blocks(frame, info, list(dataset), list(cols), list(ids), block_rows=size)


def pack_folded(rows: DataFrame, dataset: list[str], label: str, cols: list[str], order: str, ties: list[str] = (), k: int | None = 5, block_rows: int = BLOCK_ROWS, edges: bool = True, folds: int = 5) -> Blocks:
    """Blocks of rows without folds, which are dealt as :func:`splits.stratified_folds` deals them: by rank inside (dataset,
    label) in the order of ``order``, a hex md5, and of the numeric ``ties``. A block is a range of the hash (even by construction), so
    one shuffle both ranks the rows and gathers them; ranks go on from the counts of the ranges before."""
    for c in (*dataset, label, order):
        rows = rows.filter(F.col(c).isNotNull())
    size = _block_rows(cols, block_rows)
    names, sizes = _labels(rows, dataset, label, size)
    start = F.conv(F.substring(order, 1, 8), 16, 10).cast("long").alias("_start")  # the first 32 bits
    hashed = rows.select(*dataset, F.col(label).alias("_label"), start, F.unhex(order).alias("_h"), *[F.col(c).cast("double").alias(f"_t{i}") for i, c in enumerate(ties)], *_values(cols))
    d = attach(hashed, sizes.join(names, dataset), dataset, 256)
    d = d.withColumn("block", F.shiftright(F.col("_start") * F.col("blocks"), 32).cast("int")).withColumn("_y", _code("_label"))
    per = d.groupBy(*dataset, "block", "_y").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*dataset, "_y").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = cut(per.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    per = per.select(*[F.col(c).alias(c) for c in per.columns])  # other columns than those it was made of
    d = d.drop("_label", "_start", "classes")
    keep = [f for f in d.schema.fields if f.name in (*dataset, "block", "blocks")]
    schema = StructType(keep + [StructField(n, BinaryType()) for n in ("x", "y", "fold", "key")])
    dims, n_ties = len(cols), len(ties)

    def build(t: pa.Table, before: pa.Table) -> pa.Table:
        code, y = pa.chunked_array(t.column("_h").chunks, pa.binary()).combine_chunks(), t.column("_y").to_numpy()
        code = pa.concat_arrays(code.chunks) if isinstance(code, pa.ChunkedArray) else code
        at = np.frombuffer(code.buffers()[1], np.int32)[code.offset]
        halves = np.frombuffer(code.buffers()[2], ">u8", 2 * len(code), int(at)).reshape(-1, 2).astype(np.uint64)
        first, second = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])
        by = np.argsort(first, kind="stable")
        if (np.diff(first[by]) == 0).any():  # the other half and the ties decide, nulls first
            more = [t.column(f"_t{i}") for i in range(n_ties)]
            last = [a for c in reversed(more) for a in (c.to_numpy(), c.is_valid().to_numpy())]
            by = np.lexsort((*last, second, first))
        ranked, fold = y[by], np.zeros(len(y), np.int64)
        for c, n in zip(before.column("_y").to_pylist(), before.column("_before").to_pylist()):
            its = np.flatnonzero(ranked == c)
            fold[its] = (n + np.arange(len(its))) % folds
        out = {f.name: t.column(f.name).slice(0, 1) for f in keep}
        return pa.table({**out, **_arrays(t, by, dims, first[by] >> np.uint64(4), fold)})

    both = d.groupBy(*dataset, "block").cogroup(per.groupBy(*dataset, "block"))
    frame = cut(both.applyInArrow(build, schema), wide=True)
    info = cut(training_info(rows, frame, names, dataset, cols, k, edges=edges))
    return Blocks(frame, info, list(dataset), list(cols), [], block_rows=size)


def _way(info: dict) -> tuple:
    return info["outer"], info["imputer"], info["standardize"]


def _learners() -> dict:
    from perfgrid.operators.learners import LEARNERS

    return LEARNERS


def start_models(b: Blocks, tasks: DataFrame) -> DataFrame:
    """One row for each model to train: tasks (dataset, config_id, algorithm, hyperparameters, outer), perhaps
    with ``imputer`` (mean) and ``standardize`` (true), and ``part`` for learners that are made of several models."""
    parts = {name: learner.parts for name, learner in _learners().items()}
    count = F.lit(1)
    for name, (key, default) in ((n, p) for n, p in parts.items() if p):
        count = F.when(F.col("algorithm") == name, F.coalesce(F.try_element_at("hyperparameters", F.lit(key)).cast("int"), F.lit(default))).otherwise(count)
    default = {"imputer": F.lit("mean"), "standardize": F.lit(True)}
    tasks = tasks.withColumns({c: v for c, v in default.items() if c not in tasks.columns})
    t = tasks.select(*b.dataset, "config_id", "algorithm", "imputer", "standardize", F.to_json("hyperparameters").alias("h"), "outer", F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    t = t.join(b.info, [*b.dataset, "outer", "imputer"]).select(*b.dataset, "config_id", "algorithm", "h", "outer", "part", F.struct("outer", *INFO).alias("info"))
    return cut(t.withColumn("mid", F.monotonically_increasing_id()).withColumn("state", F.lit(None).cast("binary")))


def packs(models: DataFrame, keys: list[str], per: int = PACK, unit: str = "mid") -> DataFrame:
    """Models grouped into bounded packs, of about ``per`` models, within their keys; those of one unit stay
    together."""
    n = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*keys)) / per).cast("int")
    dealt = models.withColumn("_n", n).withColumn("_pack", F.pmod(F.xxhash64(unit), F.col("_n"))).drop("_n")
    fields = [c for c in models.columns if c not in keys]
    return dealt.groupBy(*keys, "_pack").agg(F.collect_list(F.struct(*fields)).alias("models"))


def _meet(b: Blocks, models: DataFrame, unit: str = "mid", ids: bool = False) -> DataFrame:
    """Blocks beside packs of models of their dataset, spread evenly over tasks. Many blocks are spread already; models
    of counted size go to them, so that a round moves no rows."""
    wanted = [*b.dataset, "blocks", "x", "y", "fold", "key", *([f"id{i}" for i in range(len(b.ids))] if ids else [])]
    both, packed = b.frame.select("block", *wanted), packs(models, b.dataset, unit=unit)
    if b.many():
        state = F.coalesce(F.length("state"), F.lit(0)).cast("long") + F.lit(1024 + 8 * BINS * len(b.cols))
        if (models.agg(F.sum(state)).first()[0] or 0) <= MODEL_BYTES:
            return both.join(F.broadcast(packed), b.dataset)  # blocks stay where they are
    both = both.join(packed, b.dataset)
    return both.repartition(4 * partitions(b.frame.sparkSession), *b.dataset, "block", "_pack")


def _beside(b: Blocks, models: DataFrame, small: DataFrame, n: int) -> DataFrame:
    """All blocks of each of ``n`` small datasets beside packs of its models, a dataset and pack after the other."""
    least = 4 * partitions(b.frame.sparkSession)
    tasks = max(least, min(4 * least, 512))
    its = Window.partitionBy(*b.dataset)
    per = F.greatest(F.lit(min(WHOLE_PACKS, -(-tasks // n))), F.ceil(F.count(F.lit(1)).over(its) / (16 * PACK)).cast("int"))
    dealt = models.join(small, b.dataset, "left_semi").withColumn("_pack", F.pmod(F.row_number().over(its.orderBy("algorithm", "mid")), per))
    fields = [c for c in models.columns if c not in b.dataset]
    packed = dealt.groupBy(*b.dataset, "_pack").agg(F.collect_list(F.struct(*fields)).alias("models"))
    both = b.frame.select(*b.dataset, "block", "x", "y", "fold", "key").join(packed, b.dataset)
    return both.repartition(tasks, *b.dataset, "_pack").sortWithinPartitions(*b.dataset, "_pack", "block")


def plain(batch: pa.RecordBatch, at: int) -> dict:
    """One row as Python values; the lists of row ids stay Arrow arrays."""
    ids = lambda n: n[:2] == "id" and n[2:].isdigit()
    return {n: batch.column(i)[at].values if ids(n) else batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}


def _rows(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[dict, Data]]:
    for batch in batches:
        for a in range(batch.num_rows):
            row = plain(batch, a)
            yield row, Data(row, dims)


def _size(stat: dict) -> int:
    return sum(v.nbytes for v in stat.values())


def _added(a: dict | None, b: dict) -> dict:
    """Sum of two statistics; what only one of them has is kept."""
    if a is None:
        return dict(b)
    for name, v in b.items():
        a[name] = a[name] + v if name in a else v
    return a


def train(b: Blocks, tasks: DataFrame) -> DataFrame:
    """Settled models of all tasks: (dataset, config_id, algorithm, h, outer, part, info, mid, state)."""
    dims, dataset = len(b.cols), b.dataset
    models = start_models(b, tasks)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a dataset and pack follow each other; all rounds of its models, on all its blocks at once."""
        learners = _learners()

        def trained(blocks: list[Data], models: list[dict]) -> Iterator[pa.RecordBatch]:
            way = None
            for m in sorted(models, key=lambda m: _way(m["info"])):
                if _way(m["info"]) != way:  # one preparation at a time is kept
                    way = _way(m["info"])
                    for data in blocks:
                        data.leave()
                learner, h, info = learners[m["algorithm"]], json.loads(m["h"] or "{}"), m["info"]
                state = learner.start(h, info, m["part"])
                while not state.get("done"):
                    total = None
                    for data in blocks:
                        total = _added(total, learner.partial(state, data, h, info))
                    state = learner.update(state, total, h, info)
                for data in blocks:
                    data.forget()
                yield pa.RecordBatch.from_arrays([pa.array([m["mid"]], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], ["mid", "state"])

        now, blocks, its = None, [], []
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for a in range(batch.num_rows):
                key = tuple(batch.column(at[n])[a].as_py() for n in (*dataset, "_pack"))
                if key != now:
                    yield from trained(blocks, its)
                    now, blocks, its = key, [], batch.column(at["models"])[a].as_py()
                blocks.append(Data({n: batch.column(at[n])[a].as_py() for n in ("x", "y", "fold", "key")}, dims))
        yield from trained(blocks, its)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learners, held, size, names = _learners(), {}, 0, ["mid", "state", "stat", "done"]

        def line(mid: int, state: bytes | None, stat: bytes | None, done: bool):
            return pa.RecordBatch.from_arrays([pa.array([mid], pa.int64()), pa.array([state], pa.binary()), pa.array([stat], pa.binary()), pa.array([done])], names)

        for row, data in _rows(batches, dims):
            for m in row["models"]:
                learner, h, info = learners[m["algorithm"]], json.loads(m["h"] or "{}"), m["info"]
                state = learner.start(h, info, m["part"]) if m["state"] is None else pickle.loads(m["state"])
                if state.get("done"):
                    yield line(m["mid"], pickle.dumps(state), None, True)
                else:
                    stat = learner.partial(state, data, h, info)
                    size -= _size(held[m["mid"]]) if m["mid"] in held else 0
                    held[m["mid"]] = _added(held.get(m["mid"]), stat)
                    size += _size(held[m["mid"]])
                    if size > FLUSH_BYTES:
                        yield from (line(i, None, pickle.dumps(s), False) for i, s in held.items())
                        held, size = {}, 0
                data.forget()
        yield from (line(i, None, pickle.dumps(s), False) for i, s in held.items())

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by model, its own row first, then its statistics; gives the model's row with its next state."""
        learners, now, total = _learners(), None, None

        def moved() -> pa.RecordBatch:
            row = {n: now.column(i)[0].as_py() for i, n in enumerate(now.schema.names)}
            learner, h = learners[row["algorithm"]], json.loads(row["h"] or "{}")
            state = learner.start(h, row["info"], row["part"]) if row["state"] is None else pickle.loads(row["state"])
            state = learner.update(state, total, h, row["info"])
            cols = [pa.array([pickle.dumps(state)], pa.binary()) if n == "state" else now.column(n) for n in static]
            return pa.RecordBatch.from_arrays([*cols, pa.array([bool(state.get("done"))])], [*static, "done"])

        for batch in batches:
            stats = batch.column("stat")
            for a in range(batch.num_rows):
                if stats[a].is_valid:
                    total = _added(total, pickle.loads(stats[a].as_py()))
                else:
                    if now is not None and total is not None:
                        yield moved()
                    now, total = batch.slice(a, 1), None
        if now is not None and total is not None:
            yield moved()

    static = models.columns
    after = StructType([*models.schema.fields, StructField("done", BooleanType())])
    states, open_ = [], models
    sizes = cut(b.frame.select(*dataset, (F.col("blocks") <= b.whole()).alias("_small")).distinct())
    small, few = sizes.filter("_small").select(*dataset), sizes.agg(F.count_if("_small").alias("n"), F.count_if(~F.col("_small")).alias("others")).first()
    if few.n:
        states.append(cut(_beside(b, models.drop("config_id"), small, few.n).mapInArrow(settle, "mid long, state binary"), wide=True))
        open_ = cut(models.join(small, dataset, "left_anti")) if few.others else models
    while few.others:
        seen = cut(_meet(b, open_.drop("config_id")).mapInArrow(partial, "mid long, state binary, stat binary, done boolean"), wide=True)
        n = seen.agg(F.count(F.when(F.col("done"), 1)).alias("done"), F.count("stat").alias("stats")).first()
        if n.done:
            states.append(seen.filter("done").groupBy("mid").agg(F.first("state").alias("state")))
        if not n.stats:
            break
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in models.schema.fields if f.name != "mid"]
        sums = seen.filter("stat IS NOT NULL").select("mid", *blank, "stat").select(*static, "stat")
        lines = open_.withColumn("stat", F.lit(None).cast("binary")).unionByName(sums)
        lines = lines.repartition("mid").sortWithinPartitions("mid", F.col("stat").isNotNull())
        moved = cut(lines.mapInArrow(advance, after), wide=True)
        n = moved.agg(F.count(F.when(F.col("done"), 1)).alias("done"), F.count(F.lit(1)).alias("all")).first()
        if n.done:
            states.append(moved.filter("done").select("mid", "state"))
        if n.done == n["all"]:
            break
        open_ = moved.filter("NOT done").select(*static)
    if not states:
        return models.limit(0)
    ready = states[0]
    for more in states[1:]:
        ready = ready.unionByName(more)
    return cut(models.drop("state").join(ready, "mid").select(*static))


def _predicted(m: list[dict], data: Data, learners: dict) -> tuple[np.ndarray, np.ndarray]:
    """(rows, codes) of the rows that a model was not trained on (all rows for a whole model)."""
    info, h = m[0]["info"], json.loads(m[0]["h"] or "{}")
    rows = np.flatnonzero(data.fold == info["outer"]) if info["outer"] >= 0 else np.arange(len(data.y))
    states = [pickle.loads(x["state"]) for x in sorted(m, key=lambda x: x["part"])]
    return rows, learners[m[0]["algorithm"]].predict(states, data, rows, h, info) if len(rows) else np.zeros(0, np.int64)


def _by_config(models: list[dict]) -> list[list[dict]]:
    out: dict = {}
    for m in models:
        out.setdefault((m["config_id"], m["outer"]), []).append(m)
    return list(out.values())


def confusion(b: Blocks, models: DataFrame) -> DataFrame:
    """(dataset, config_id, fold, _y, _p, _n): out-of-fold counts of label codes against predicted codes. Rows
    are never exploded by model: a task gives one row for each pair of codes it met."""
    dims, dataset = len(b.cols), b.dataset
    fields = [f for f in b.frame.schema.fields if f.name in dataset] + [f for f in models.schema.fields if f.name == "config_id"]
    schema = StructType(fields)
    for n, t in (("fold", IntegerType()), ("_y", IntegerType()), ("_p", IntegerType()), ("_n", LongType())):
        schema = schema.add(n, t)
    arrow = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learners = _learners()
        for batch in batches:
            of = {f.name: f.type for f in batch.schema}
            config_type = of["models"].value_type.field("config_id").type
            for row, data in _rows(iter([batch]), dims):
                lines = []
                for m in _by_config(row["models"]):
                    rows, p = _predicted(m, data, learners)
                    known = data.y[rows] >= 0
                    wide = len(m[0]["info"]["classes"])
                    n = np.bincount(data.y[rows][known].astype(np.int64) * wide + np.asarray(p)[known].astype(np.int64))
                    lines += [(m[0]["config_id"], m[0]["outer"], *divmod(int(i), wide), int(n[i])) for i in np.flatnonzero(n)]
                if lines:
                    cols = list(zip(*lines))
                    same = [pa.array([row[n]] * len(lines), of[n]) for n in dataset]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(cols[0], config_type), *[pa.array(c, t) for c, t in zip(cols[1:], arrow)]], schema.names)

    met = _meet(b, models.select(*dataset, "config_id", "algorithm", "h", "outer", "part", "info", "state"), unit="config_id")
    return met.mapInArrow(count, schema).groupBy(*dataset, "config_id", "fold", "_y", "_p").agg(F.sum("_n").alias("_n"))


def predictions(b: Blocks, models: DataFrame) -> DataFrame:
    """(dataset, ids.., config_id, fold, label, prediction) of every row that a model was not trained on."""
    dims, dataset, n_ids = len(b.cols), b.dataset, len(b.ids)
    types = {f.name: f.dataType for f in b.frame.schema.fields}
    schema = StructType([StructField(n, types[n]) for n in dataset])
    for i, c in enumerate(b.ids):
        schema = schema.add(c, types[f"id{i}"].elementType)
    schema = schema.add("config_id", models.schema["config_id"].dataType).add("fold", IntegerType()).add("_y", IntegerType()).add("_p", IntegerType())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learners = _learners()
        for batch in batches:
            of = {f.name: f.type for f in batch.schema}
            config_type = of["models"].value_type.field("config_id").type
            for row, data in _rows(iter([batch]), dims):
                for m in _by_config(row["models"]):
                    rows, p = _predicted(m, data, learners)
                    if len(rows):
                        cols = [pa.array([row[n]] * len(rows), of[n]) for n in dataset]
                        cols += [row[f"id{i}"].take(pa.array(rows)) for i in range(n_ids)]
                        cols += [pa.array([m[0]["config_id"]] * len(rows), config_type), pa.array(data.fold[rows].astype(np.int32)), pa.array(data.y[rows]), pa.array(np.asarray(p).astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(cols, schema.names)

    met = _meet(b, models.select(*dataset, "config_id", "algorithm", "h", "outer", "part", "info", "state"), unit="config_id", ids=True)
    found = met.mapInArrow(each, schema)
    names = broadcast_checked(cut(b.info.filter("outer = -1").select(*dataset, "classes").distinct()), 256)
    label = lambda c: F.get("classes", F.col(c))
    return found.join(names, dataset).select(*dataset, *b.ids, "config_id", "fold", F.when(F.col("_y") >= 0, label("_y")).alias("label"), label("_p").alias("prediction"))


def model_table(models: DataFrame, dataset: list[str], cols: list[str]) -> DataFrame:
    """(dataset, config_id, outer, part, round, label, place, feature, cut, value): splits, leaves, stumps and
    weights of settled models as rows; a model that predicts one class has none."""
    names = [*dataset, "config_id", "outer", "part"]
    schema = StructType([models.schema[n] for n in names])
    for n, t in (("round", IntegerType()), ("label", StringType()), ("place", LongType()), ("feature", StringType()), ("cut", DoubleType()), ("value", DoubleType())):
        schema = schema.add(n, t)
    types = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learners = _learners()
        for batch in batches:
            of = {f.name: f.type for f in batch.schema}
            for a in range(batch.num_rows):
                m = {n: batch.column(i)[a].as_py() for i, n in enumerate(batch.schema.names)}
                state = pickle.loads(m["state"])
                lines = [] if "constant" in state else [(r, str(c), p, None if f is None else cols[f], cut, v) for r, c, p, f, cut, v in learners[m["algorithm"]].table(state, m["info"])]
                if lines:
                    same = [pa.array([m[n]] * len(lines), of[n]) for n in names]
                    yield pa.RecordBatch.from_arrays([*same, *[pa.array(c, t) for c, t in zip(zip(*lines), types)]], schema.names)

    return models.select(*names, "algorithm", "info", "state").mapInArrow(rows, schema)
