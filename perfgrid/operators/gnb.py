"""Gaussian naive Bayes for all datasets, left-out folds and preparations at once.

The moments of every (dataset, fold, class, feature) are taken in one scan. What
imputation with a constant fill, scaling and feature selection do to them follows
in closed form, so further preparations cost no further scan of the rows.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from perfgrid.operators import prep
from perfgrid.session import broadcast_checked, cut

SMOOTHING = 1e-9
WHOLE = -1
COUNT_BYTES = 32 << 20  # models that go to every task which counts predictions
COUNT_ROWS = 65_536  # rows a task gathers before it scores them by dataset and fold
STEP = 1 << 15  # scores that are held at once, so that they stay in the cache


def class_moments(df: DataFrame, dataset: list[str], label: str, cols: list[str], k: int | None) -> DataFrame:
    """Training moments per (dataset, outer, label, feature); without folds outer = -1."""
    keys = [*dataset, label]
    if k is None:
        return prep.moments(df, keys, cols).withColumn("outer", F.lit(WHOLE)).withColumnRenamed(label, "label")
    per_fold = prep.moments(df, [*keys, "fold"], cols)
    return prep.leave_out(per_fold, [*keys, "feature"], k).withColumnRenamed(label, "label")


def with_fill(stats: DataFrame, keys: list[str], fills: DataFrame | None) -> DataFrame:
    """Moments after missing values became the fill; mean fill needs no table."""
    w = Window.partitionBy(*keys, "outer", "feature")
    if fills is None:
        d = stats.withColumn("fill", F.try_divide(F.sum(F.col("n") * F.coalesce("mean", F.lit(0.0))).over(w), F.sum("n").over(w)))
    else:
        d = stats.join(fills, [*keys, "outer", "feature"], "left")
    d = d.filter(F.col("fill").isNotNull())  # columns without any training value drop out
    gone = F.col("n_all") - F.col("n")
    m0 = F.coalesce("mean", F.lit(0.0))
    mean = (F.col("n") * m0 + gone * F.col("fill")) / F.col("n_all")
    d = d.withColumn("_m", mean)
    dev = F.col("n") * (F.coalesce("var", F.lit(0.0)) + (m0 - F.col("_m")) * (m0 - F.col("_m")))
    dev = dev + gone * (F.col("fill") - F.col("_m")) * (F.col("fill") - F.col("_m"))
    return d.withColumn("var", dev / F.col("n_all")).withColumn("mean", F.col("_m")).withColumn("n", F.col("n_all")).drop("_m")


def scaled(stats: DataFrame, keys: list[str], scale: bool | Column) -> DataFrame:
    """Moments after standardization; shift 0 and divisor 1 where it is off."""
    on = F.lit(scale) if isinstance(scale, bool) else scale
    w = Window.partitionBy(*keys, "outer", "feature")
    n = F.sum("n").over(w)
    d = stats.withColumn("shift", F.sum(F.col("n") * F.col("mean")).over(w) / n)
    gap = F.col("mean") - F.col("shift")
    d = d.withColumn("total_var", F.sum(F.col("n") * (F.col("var") + gap * gap)).over(w) / n)
    sd = F.sqrt("total_var")
    d = d.withColumn("sd", F.when(on & (sd > 0), sd).otherwise(F.lit(1.0))).withColumn("shift", F.when(on, F.col("shift")).otherwise(F.lit(0.0)))
    return (
        d.withColumn("mean", (F.col("mean") - F.col("shift")) / F.col("sd"))
        .withColumn("var", F.col("var") / (F.col("sd") * F.col("sd")))
        .withColumn("total_var", F.col("total_var") / (F.col("sd") * F.col("sd")))
    )


def reduced(stats: DataFrame, keys: list[str], reducer: str | None | Column, k: Column | int | None = None) -> DataFrame:
    """Keeps all features, varying ones, or the k best by ANOVA F of the training rows.

    Reducer and k may be columns, so that one job serves many configs.
    """
    if reducer is None:
        return stats
    name = F.lit(reducer) if isinstance(reducer, str) else reducer
    limit = F.lit(k) if k is None or isinstance(k, int) else k
    groups = [*keys, "outer"]
    w = Window.partitionBy(*groups).orderBy(F.col("f").desc_nulls_last(), "feature")
    place = prep.anova_f_of(stats, groups).select(*groups, "feature", F.row_number().over(w).alias("_place"))
    keep = F.when(name == "VarianceThreshold", F.col("total_var") > 0).when(name == "SelectKBest", F.col("_place") <= limit).otherwise(F.lit(True))
    return stats.join(place, [*groups, "feature"], "left").filter(keep).drop("_place")


def models(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (dataset, outer): feature preparation and class parameters.

    Variances get 1e-9 of the largest feature variance; when no feature varies at
    all, only the class shares decide. Both arrays are as long as
    the feature list and the class list.
    """
    groups = [*keys, "outer"]
    w = Window.partitionBy(*groups)
    d = stats.withColumn("_eps", F.max("total_var").over(w) * SMOOTHING)
    wide = F.col("var") + F.col("_eps")
    part = F.struct("feature", "mean", wide.alias("var"), F.coalesce(F.try_divide(F.lit(-0.5), wide), F.lit(0.0)).alias("half"))
    prep_part = F.struct("feature", "fill", "shift", "sd")
    per_class = d.groupBy(*groups, "label").agg(
        F.max("n_all").alias("n"), F.array_sort(F.collect_list(part)).alias("p"), F.array_sort(F.collect_list(prep_part)).alias("q")
    )
    total = F.sum("n").over(w)
    per_class = per_class.withColumn("prior", F.col("n") / total).withColumn("_prior", F.log("prior"))
    const = F.aggregate("p", F.lit(0.0), lambda s, x: s - F.lit(0.5) * F.coalesce(F.log(F.lit(2 * math.pi) * x["var"]), F.lit(0.0)))
    cls = F.struct(F.col("label"), (F.col("_prior") + const).alias("base"), "p", "prior")
    return per_class.groupBy(*groups).agg(F.array_sort(F.collect_list(cls)).alias("classes"), F.first("q").alias("prep"))


def fit(
    df: DataFrame, dataset: list[str], label: str, cols: list[str], k: int | None = 5, fills: DataFrame | None = None,
    scale: bool = False, reducer: str | None = None, best: int | None = None,
) -> DataFrame:
    """Models of every dataset (and left-out fold) with one preparation."""
    stats = with_fill(class_moments(df, dataset, label, cols, k), dataset, fills)
    return models(reduced(scaled(stats, dataset, scale), dataset, reducer, best), dataset)


def aligned(entries: Column, cols: list[str], field: str, default: float) -> Column:
    """Array over the given features from (feature, ..) structs; absent ones get the default."""
    lookup = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["feature"], e[field])))
    return F.array(*[F.coalesce(F.element_at(lookup, F.lit(c)), F.lit(default)) for c in cols])


def prepared(cols: list[str], fill: Column, shift: Column, sd: Column) -> list[Column]:
    """Prepared features as plain expressions, so that they stay in generated code."""
    return [(F.coalesce(F.col(c).cast("double"), F.get(fill, F.lit(j))) - F.get(shift, F.lit(j))) / F.get(sd, F.lit(j)) for j, c in enumerate(cols)]


def best_label(classes: str, n_classes: int, score: Callable[[Column], Column]) -> Column:
    """Label of the largest score; classes are in label order, so ties go to the smallest.

    The scores of the n_classes possible classes are plain expressions (generated
    code); positions beyond a row's own classes are NULL and never win.
    """
    at = [F.get(classes, F.lit(i)) for i in range(n_classes)]
    scores = [score(c) for c in at]
    top = F.greatest(*scores) if n_classes > 1 else scores[0]
    out = None
    for s, c in zip(scores, at):
        out = F.when(s == top, c["label"]) if out is None else out.when(s == top, c["label"])
    return out


def join_models(df: DataFrame, ready: DataFrame, keys: list[str], width: int) -> tuple[DataFrame, int]:
    """Rows with their models, and the largest number of classes of any model.

    Models are few next to rows: counted, they are broadcast when they fit, so that
    rows (and a dataset holding most of them) are not shuffled at all.
    """
    ready = cut(ready)
    n = ready.agg(F.max(F.size("_classes"))).first()[0] or 1
    return df.join(broadcast_checked(ready, 16 * (width + 2) * (2 * n + 3)), keys), n


def as_arrays(model: DataFrame, cols: list[str]) -> DataFrame:
    """Preparation and class parameters as arrays in the order of the columns."""
    per_class = lambda c: F.struct(
        c["label"].alias("label"), c["base"].alias("base"), aligned(c["p"], cols, "mean", 0.0).alias("m"), aligned(c["p"], cols, "half", 0.0).alias("a")
    )
    return (
        model.withColumn("_fill", aligned(F.col("prep"), cols, "fill", 0.0))
        .withColumn("_shift", aligned(F.col("prep"), cols, "shift", 0.0))
        .withColumn("_sd", aligned(F.col("prep"), cols, "sd", 1.0))
        .withColumn("_classes", F.transform("classes", per_class))
        .drop("prep", "classes")
    )


class _Scorer:
    """All configs of one dataset and left-out fold as arrays; classes a config lacks never win."""

    def __init__(self, models: list[tuple], dims: int):
        self.configs = [m[0] for m in models]
        self.labels = [[c[0] for c in m[4]] for m in models]
        most = max([1, *(len(x) for x in self.labels)])
        self.fill, self.shift, self.sd = (np.array([m[i] for m in models], float).reshape(-1, dims) for i in (1, 2, 3))
        self.base, self.able = np.zeros((len(models), most)), np.zeros((len(models), most), bool)
        self.m, self.a = np.zeros((len(models), most, dims)), np.zeros((len(models), most, dims))
        for i, m in enumerate(models):
            for j, (_, base, mean, half) in enumerate(m[4]):
                if base is not None:
                    self.base[i, j], self.able[i, j], self.m[i, j], self.a[i, j] = base, True, mean, half
        self.some = self.able.any(axis=1)

    def codes(self, x: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """(config, row) place of the best class, the steps being those of :func:`predict`."""
        total = np.repeat(self.base[:, :, None], len(x), axis=2)
        gap, one = np.empty_like(total), np.empty((len(self.base), len(x)))
        with np.errstate(all="ignore"):
            for j in range(x.shape[1]):
                one[:] = x[None, :, j]
                if gone[:, j].any():
                    np.copyto(one, self.fill[:, j, None], where=gone[None, :, j])
                one -= self.shift[:, j, None]
                one /= self.sd[:, j, None]
                np.subtract(one[:, None, :], self.m[:, :, j, None], out=gap)
                gap *= gap
                gap *= self.a[:, :, j, None]
                total += gap
        total[~self.able] = -np.inf
        return total.argmax(axis=1)


class _Models:
    """Scorers of all models beside the tasks, by dataset and left-out fold; None where they are too many for that."""

    def __init__(self, held: dict, dims: int):
        self.held, self.dims, self.made = held, dims, {}

    @classmethod
    def of(cls, model: DataFrame, dataset: list[str], cols: list[str]) -> tuple[_Models | None, StructType]:
        dims = len(cols)
        ready = cut(as_arrays(model, cols).select(*dataset, "config_id", "outer", "_fill", "_shift", "_sd", "_classes"))
        size = ready.agg(F.sum(16 * (F.size("_classes") * (2 * dims + 3) + 3 * dims + 4))).first()[0] or 0
        if size > COUNT_BYTES:
            return None, ready.schema
        held: dict = {}
        for r in ready.collect():
            one = (r["config_id"], r["_fill"], r["_shift"], r["_sd"], [(c["label"], c["base"], c["m"], c["a"]) for c in r["_classes"]])
            held.setdefault((*[r[c] for c in dataset], r["outer"]), []).append(one)
        return cls({k: sorted(v, key=lambda m: m[0]) for k, v in held.items()}, dims), ready.schema

    def __getitem__(self, key: tuple) -> _Scorer | None:
        if key not in self.made:
            self.made[key] = _Scorer(self.held[key], self.dims) if key in self.held else None
        return self.made[key]

    def scored(self, t: pa.Table, keys: list[str], step: int) -> Iterator[tuple[tuple, _Scorer, np.ndarray, np.ndarray, list]]:
        """(key, scorer, places of the best classes by config and row, label numbers, names of these) of bounded parts of the rows."""
        y = t.column("_y").combine_chunks().dictionary_encode()
        names = [*y.dictionary.to_pylist(), None]
        code = y.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        x = [t.column(f"_x{i}") for i in range(self.dims)]
        gone = np.stack([c.is_null().to_numpy() for c in x], axis=1) if x else np.zeros((t.num_rows, 0), bool)
        x = np.stack([c.to_numpy().astype(float) for c in x], axis=1) if x else np.zeros((t.num_rows, 0))
        for key, rows in t.select(keys).to_pandas().groupby(keys, sort=False).indices.items():
            s = self[key]
            if s is not None:
                n = max(1, step // s.base.size)
                for a in range(0, len(rows), n):
                    at = rows[a : a + n]
                    yield key, s, s.codes(x[at], gone[at]), code[at], names


def _numeric(df: DataFrame, keys: list[str], cols: list[str], label: str) -> DataFrame:
    known = df.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))
    return known.select(*keys, F.col(label).alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to some thousand rows."""
    wait, n = [], 0
    for batch in batches:
        wait.append(batch)
        n += batch.num_rows
        if n >= COUNT_ROWS:
            yield pa.Table.from_batches(wait)
            wait, n = [], 0
    if wait:
        yield pa.Table.from_batches(wait)


def predicted_counts(df: DataFrame, model: DataFrame, dataset: list[str], cols: list[str], label: str = "label") -> DataFrame:
    """(dataset, config_id, fold, _y, _p, _n): out-of-fold counts of labels against the predictions of every config.

    Rows are not exploded by config: each task scores its rows by all configs of their dataset and fold and gives the
    counts it met. Models beyond a counted size are joined to rows instead.
    """
    keys = [*dataset, "fold"]
    models, kinds = _Models.of(model, dataset, cols)
    if models is None:
        pred = predict(df, model, dataset, cols)
        return pred.groupBy(*dataset, "config_id", "fold", F.col(label).alias("_y"), F.col("prediction").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    shared = df.sparkSession.sparkContext.broadcast(models)
    said = kinds["_classes"].dataType.elementType["label"].dataType
    fields = [df.schema[c] for c in dataset] + [kinds["config_id"], df.schema["fold"]]
    schema = StructType([*fields, StructField("_y", df.schema[label].dataType), StructField("_p", said), StructField("_n", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, types = Counter(), to_arrow_schema(schema)

        def given() -> pa.RecordBatch:
            columns = list(zip(*[(*k, n) for k, n in totals.items()])) or [()] * len(types)
            totals.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(columns, types)], types.names)

        for t in _tables(batches):
            found: dict = {}
            for key, s, codes, code, names in shared.value.scored(t, keys, STEP):
                most = s.base.shape[1]
                place = (np.arange(len(s.configs))[:, None] * most + codes) * len(names) + code
                n = np.bincount(place.ravel(), minlength=s.base.size * len(names))
                found[key] = found[key] + n if key in found else n
            for key, n in found.items():
                s = shared.value[key]
                most = s.base.shape[1]
                for i in np.flatnonzero(n):
                    (c, p), v = divmod(int(i) // len(names), most), int(i) % len(names)
                    totals[(*key[:-1], s.configs[c], key[-1], names[v], s.labels[c][p] if s.some[c] else None)] += int(n[i])
            if len(totals) > 200_000:
                yield given()
        yield given()

    return _numeric(df, keys, cols, label).mapInArrow(count, schema).groupBy(*dataset, "config_id", "fold", "_y", "_p").agg(F.sum("_n").alias("_n"))


def predicted_patterns(df: DataFrame, model: DataFrame, dataset: list[str], cols: list[str], label: str = "label") -> DataFrame | None:
    """(dataset, label, votes, n): how many rows have this label and these out-of-fold predictions (m: config, p: label) of all configs, in
    order of the configs. Rows are scored inside a task, and counts leave it. None where the models are too large for that."""
    keys = [*dataset, "fold"]
    models, kinds = _Models.of(model, dataset, cols)
    if models is None:
        return None
    shared = df.sparkSession.sparkContext.broadcast(models)
    vote = StructType([StructField("m", kinds["config_id"].dataType), StructField("p", kinds["_classes"].dataType.elementType["label"].dataType)])
    schema = StructType([*[df.schema[c] for c in dataset], StructField("label", df.schema[label].dataType), StructField("votes", ArrayType(vote)), StructField("n", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, types = Counter(), to_arrow_schema(schema)

        def given() -> pa.RecordBatch:
            lines = []
            for (key, y, places), n in totals.items():
                s = shared.value[key]
                places = np.frombuffer(places, np.int32)
                votes = [{"m": c, "p": s.labels[i][p] if s.some[i] else None} for i, (c, p) in enumerate(zip(s.configs, places))]
                lines.append((*key[:-1], y, votes, n))
            totals.clear()
            columns = list(zip(*lines)) or [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(columns, types)], types.names)

        for t in _tables(batches):
            for key, s, codes, code, names in shared.value.scored(t, keys, STEP):
                lines = np.ascontiguousarray(np.concatenate([code[None, :], codes]).T.astype(np.int32))
                each, n = np.unique(lines.view(np.dtype((np.void, lines.dtype.itemsize * lines.shape[1]))).ravel(), return_counts=True)
                for line, k in zip(each.tolist(), n.tolist()):
                    totals[key, names[int.from_bytes(line[:4], sys.byteorder)], line[4:]] += k
            if len(totals) > 50_000:
                yield given()
        yield given()

    found = _numeric(df, keys, cols, label).mapInArrow(count, schema)
    return found.groupBy(*dataset, "label", "votes").agg(F.sum("n").alias("n"))


def predict(df: DataFrame, model: DataFrame, dataset: list[str], cols: list[str], out: str = "prediction") -> DataFrame:
    """Prediction of every row by the model that left out its fold (or the whole model).

    ``model`` may hold several configs; the rows then come once per config.
    """
    ready = as_arrays(model, cols)
    d = df.withColumn("outer", F.col("fold")) if "fold" in df.columns else df.withColumn("outer", F.lit(WHOLE))
    d, n_classes = join_models(d, ready, [*dataset, "outer"], len(cols))
    xs = [f"_x{j}" for j in range(len(cols))]
    d = d.withColumns(dict(zip(xs, prepared(cols, F.col("_fill"), F.col("_shift"), F.col("_sd")))))

    def score(c: Column) -> Column:
        total = c["base"]
        for j, x in enumerate(xs):
            gap = F.col(x) - F.get(c["m"], F.lit(j))
            total = total + gap * gap * F.get(c["a"], F.lit(j))
        return total

    return d.withColumn(out, best_label("_classes", n_classes, score)).drop("_classes", "_fill", "_shift", "_sd", "outer", *xs)
