"""Stumps and multi-class boosting over many datasets at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfgrid.session import broadcast_checked, cut

MAX_CLASSES = 1000
BLOCK_ROWS, BLOCK_CELLS = 32_768, 1 << 20
FEW_VALUES = 256  # values of a feature in a dataset that every block may list
BLOCK_DDL = "_d bigint, f int, b bigint, n int, first double, x binary, z binary, y binary"
PART_DDL = "_d bigint, f int, b bigint, value double, top double, w array<double>"
SPLIT_DDL = "_d bigint, f int, gini double, value double, next double, lo int, hi int, error double"
STUMPS = "array<struct<f:int,threshold:double,lo:int,hi:int,alpha:double,error:double>>"
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
BLOCK, PART, SPLIT = (pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ddl.split(", ")]) for ddl in (BLOCK_DDL, PART_DDL, SPLIT_DDL))


def _pack(feature: int, n_cols: int) -> Callable:
    """Sorted rows as blocks of one dataset; a block's number grows with its partition and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, owner = TaskContext.get().partitionId() << 32, [], 0, None

        def flush() -> pa.RecordBatch:
            x, z, y = (np.concatenate([h[i] for h in held], axis=-1) for i in range(3))
            first = None if feature < 0 or z[feature][0] else float(x[feature][0])
            row = {"_d": owner, "f": feature, "b": number, "n": n, "first": first, "x": x.tobytes(), "z": z.tobytes(), "y": y.tobytes()}
            return pa.RecordBatch.from_pylist([row], BLOCK)

        for batch in batches:
            owners = batch.column(0).to_numpy()
            y = batch.column(1).to_numpy().astype(np.int16)
            cols = [batch.column(2 + i) for i in range(n_cols)]
            z = np.array([c.is_null().to_numpy(zero_copy_only=False) for c in cols])
            x = np.array([c.fill_null(0.0).to_numpy() for c in cols])
            at = 0
            while at < len(owners):
                if held and (owner != owners[at] or n >= BLOCK_ROWS):
                    yield flush()
                    number, held, n = number + 1, [], 0
                owner = int(owners[at])
                end = min(int(np.searchsorted(owners, owner, "right")), at + BLOCK_ROWS - n)
                held.append((x[:, at:end], z[:, at:end], y[at:end]))
                n, at = n + end - at, end
        if held:
            yield flush()

    return run


def _opened(row: dict, n_cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values, their null flags and label codes of a block, and what its rows were missed by."""
    x, z = (np.frombuffer(row[c], t).reshape(n_cols, -1) for c, t in (("x", np.float64), ("z", np.bool_)))
    y, m = np.frombuffer(row["y"], np.int16), np.zeros(row["n"])
    for s in row["stumps"]:
        low = ((x[s["f"]] <= s["threshold"]) | np.isnan(s["threshold"])) & ~z[s["f"]]
        m = m + np.where(np.where(low, s["lo"], s["hi"]) != y, s["alpha"], 0.0)
    return x, z, y, m


def _best_split(value: np.ndarray, after: np.ndarray, left: np.ndarray, total: np.ndarray) -> dict | None:
    """Split of least weighted Gini impurity (ties to the smaller value) among those after each value; ``left`` holds the
    class weights up to it."""
    right = total - left
    l, r = left.sum(1), right.sum(1)
    ok = np.flatnonzero((l > 0) & (r > 0))  # weights may vanish
    if not len(ok):
        return None
    left, right, l, r = left[ok], right[ok], l[ok], r[ok]
    gini = np.round((l - (left * left).sum(1) / l + r - (right * right).sum(1) / r) / (l + r), 12)
    i = int(np.argmin(gini))
    error = 1.0 - (left[i].max() + right[i].max()) / (l[i] + r[i])
    return {"gini": gini[i], "value": value[ok[i]], "next": after[ok[i]], "lo": int(left[i].argmax()), "hi": int(right[i].argmax()), "error": error}


def _parts(n_cols: int, n_classes: int, small: list[int], counted: int) -> Callable:
    """What each block adds: class weights of the whole block where it is sorted by a feature, and of each value of the
    features with few values where it is a block of the copy they are counted in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, z, y, m = _opened(row, n_cols)
                top, out = float(m.max()), []
                w = np.exp(m - top)
                base = {"_d": row["_d"], "top": top}
                if row["f"] >= 0:
                    out.append(base | {"f": row["f"], "b": row["b"], "value": None, "w": np.bincount(y, w, n_classes).tolist()})
                for j in small if row["f"] == counted else []:
                    values, place = np.unique(x[j][~z[j]], return_inverse=True)
                    code = np.full(len(y), len(values))
                    code[~z[j]] = place
                    sums = np.bincount(code * n_classes + y, w, (len(values) + 1) * n_classes).reshape(-1, n_classes)
                    named = [*values.tolist(), None] if z[j].any() else values.tolist()
                    out += [base | {"f": j, "b": None, "value": v, "w": s} for v, s in zip(named, sums.tolist())]
                yield pa.RecordBatch.from_pylist(out, PART)

    return run


def _splits(n_cols: int, n_classes: int) -> Callable:
    """Best split of each block, given the class weights before it and of its dataset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, z, y, m = _opened(row, n_cols)
                w, v = np.exp(m - row["most"]), x[row["f"]]
                ends = np.append(v[1:], 0.0 if row["after"] is None else row["after"])
                last = (v < ends) | (np.isnan(ends) & ~np.isnan(v))
                last[-1] &= row["after"] is not None
                last &= ~z[row["f"]]
                total, upto, found = np.array(row["total"]), np.array(row["before"]), []
                step = max(1, BLOCK_CELLS // n_classes)
                for at in range(0, len(y), step):
                    some = slice(at, at + step)
                    hot = np.zeros((len(y[some]), n_classes))
                    hot[np.arange(len(hot)), y[some]] = w[some]
                    run_ = upto + np.cumsum(hot, axis=0)
                    upto, here = run_[-1], last[some]
                    found.append(_best_split(v[some][here], ends[some][here], run_[here], total))
                best = min((s for s in found if s), key=lambda s: s["gini"], default=None)
                if best:
                    yield pa.RecordBatch.from_pylist([{"_d": row["_d"], "f": row["f"], **best}], SPLIT)

    return run


def _small_split(t: pa.Table) -> pa.Table:
    """Best split of one feature with few values."""
    t = t.sort_by([("value", "ascending")])  # nulls come last here
    value, w = t.column("value"), np.array(t.column("w").to_pylist(), float)
    missing = value.is_null().to_numpy().astype(bool)
    v, total = value.fill_null(0.0).to_numpy()[~missing], w.sum(0)
    run = w[missing].sum(0) + np.cumsum(w[~missing], axis=0)  # rows without a value count to the left
    best = _best_split(v[:-1], v[1:], run[:-1], total) if len(v) > 1 else None
    return pa.Table.from_pylist([{"_d": t.column("_d")[0].as_py(), "f": t.column("f")[0].as_py(), **best}] if best else [], SPLIT)


def _blocks(base: DataFrame, cols: list[str]) -> tuple[DataFrame, list[int], int]:
    """(blocks, features with few values, copy these are counted in). For each feature with many values the rows are
    kept once in its order, cut into blocks wherever they lie, so that neither a dataset nor a value is one task."""
    x = [f"_x{i}" for i in range(len(cols))]
    most = base.groupBy("_d").agg(*[F.approx_count_distinct(c).alias(c) for c in x]).agg(*[F.max(c).alias(c) for c in x]).first()
    big = [i for i, c in enumerate(x) if (most[c] or 0) > FEW_VALUES]
    frame = None
    for i in big or [-1]:
        order = ["_d", *([x[i]] if i >= 0 else [])]
        d = base.withColumn("_t", F.monotonically_increasing_id()).repartitionByRange(*order, "_t").sortWithinPartitions(*order)
        one = d.select("_d", "_y", *x).mapInArrow(_pack(i, len(cols)), BLOCK_DDL)
        frame = one if frame is None else frame.unionByName(one)
    return cut(frame, wide=True), [i for i in range(len(cols)) if i not in big], (big or [-1])[0]


def best_stumps(blocks: DataFrame, after: DataFrame, models: DataFrame, n_cols: int, names: Column, n_classes: int, small: list[int], counted: int) -> DataFrame:
    """Per dataset (``_d``) the split of least weighted Gini impurity and its leaf classes, in two scans of the blocks: class
    weights of each block and of each rare value, then the best split of each block from the weights before it.
    Ties go to the smaller feature name, then the smaller threshold. Each block counts weights by its largest one, so none overflows.
    """
    known = blocks.join(broadcast_checked(models.select("_d", "stumps"), 1024), "_d")
    parts = cut(known.select("_d", "f", "b", "n", "x", "z", "y", "stumps").mapInArrow(_parts(n_cols, n_classes, small, counted), PART_DDL))
    tops = parts.groupBy("_d").agg(F.max("top").alias("most"))
    w = [(F.col("w")[c] * F.exp(F.col("top") - F.col("most"))).alias(f"_w{c}") for c in range(n_classes)]
    parts = parts.join(broadcast_checked(cut(tops), 64), "_d").select("_d", "f", "b", "value", "most", *w)
    sums = lambda window=None: F.array(*[F.coalesce(F.sum(f"_w{c}") if window is None else F.sum(f"_w{c}").over(window), F.lit(0.0)) for c in range(n_classes)])
    cells = parts.filter("b IS NULL").groupBy("_d", "f", "value").agg(sums().alias("w"))
    found = cells.groupBy("_d", "f").applyInArrow(_small_split, SPLIT_DDL)
    if counted >= 0:
        group = Window.partitionBy("_d", "f")
        so_far = group.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        state = parts.filter("b IS NOT NULL").select("_d", "f", "b", "most", sums(so_far).alias("before"), sums(group).alias("total"))
        state = cut(state.join(after, ["f", "b"]).drop("_d"))
        d = known.join(broadcast_checked(state, 64 + 16 * n_classes), ["f", "b"])
        d = d.select("_d", "f", "n", "x", "z", "y", "stumps", "most", "before", "total", "after").mapInArrow(_splits(n_cols, n_classes), SPLIT_DDL)
        found = found.unionByName(d)
    pick = F.struct("gini", F.get(names, F.col("f")).alias("name"), "value", "f", "next", "lo", "hi", "error")
    best = found.groupBy("_d").agg(F.min(pick).alias("s")).select("_d", "s.*")
    # The threshold lies midway to the next larger value of the feature.
    return best.select("_d", "f", ((F.col("value") + F.col("next")) / 2).alias("threshold"), "lo", "hi", "error")


def alpha(error: Column, n_classes: Column, rate: float) -> Column:
    """Say of a stump; NULL when it is no better than chance."""
    say = F.lit(rate) * (F.log((F.lit(1.0) - error) / F.greatest(error, F.lit(1e-12))) + F.log(n_classes - F.lit(1.0)))
    return F.when(error < F.lit(1.0) - F.lit(1.0) / n_classes, say)


def _leaf_of(stump, cols: list[str]) -> Column:
    value = F.coalesce(*[F.when(stump["feature"] == c, F.col(c).cast("double")) for c in cols])
    return F.when(value <= stump["threshold"], stump["low"]).otherwise(stump["high"])


def adaboost(rows: DataFrame, dataset: list[str], label: str, cols: list[str], n_estimators: int, rate: float = 1.0) -> DataFrame:
    """Boosted stumps (dataset, stumps array, common label) of every dataset.

    No weight is stored per row: each round recomputes it from the stumps so far,
    which are a short array per dataset, and divides it by the dataset's largest.
    Rows are read, ordered and packed once for all rounds; rows without a label take no part.
    Boosting of a dataset ends with the first stump no better than chance; one without
    any stump, as with a single class, predicts its most common label.
    """
    labelled = rows.filter(F.col(label).isNotNull())
    counts = cut(labelled.groupBy(*dataset, label).agg(F.count(F.lit(1)).alias("_n")))
    common = F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("common")
    classes = cut(counts.groupBy(*dataset).agg(F.count(F.lit(1)).alias("n_classes"), common))
    classes = cut(classes.withColumn("_d", F.monotonically_increasing_id()))
    values = sorted(r[0] for r in counts.select(label).distinct().limit(MAX_CLASSES + 1).collect())
    if len(values) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    names, leaves = F.array(*[F.lit(c) for c in cols]), F.array(*[F.lit(v) for v in values])
    models = cut(classes.select("_d", "n_classes", F.array().cast(STUMPS).alias("stumps"), F.lit(True).alias("open")))
    if values:
        code = F.array_position(leaves, F.col(label)) - 1
        base = labelled.join(broadcast_checked(classes.select(*dataset, "_d"), 64), dataset)
        base = cut(base.select("_d", code.cast("int").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)]))
        blocks, small, counted = _blocks(base, cols)
        order = Window.partitionBy("_d", "f").orderBy("b")
        after = cut(blocks.select("f", "b", F.lead("first").over(order).alias("after")))
        for _ in range(n_estimators):
            new = best_stumps(blocks, after, models.filter("open"), len(cols), names, len(values), small, counted)
            d = models.join(new, "_d", "left").withColumn("alpha", alpha(F.col("error"), F.col("n_classes").cast("double"), rate))
            more = F.coalesce(F.col("open") & (F.col("alpha") > 0), F.lit(False))
            grown = F.when(more, F.concat("stumps", F.array(F.struct("f", "threshold", "lo", "hi", "alpha", "error")))).otherwise(F.col("stumps"))
            models = cut(d.select("_d", "n_classes", grown.alias("stumps"), more.alias("open")))
            if models.filter("open").isEmpty():
                break
    named = F.transform(
        "stumps",
        lambda t: F.struct(
            F.get(names, t["f"]).alias("feature"), t["threshold"].alias("threshold"), F.get(leaves, t["lo"]).alias("low"),
            F.get(leaves, t["hi"]).alias("high"), t["alpha"].alias("alpha"), t["error"].alias("error"),
        ),
    )
    return cut(classes.join(models, "_d").select(*dataset, named.alias("stumps"), "common", "open"))


def predict(rows: DataFrame, stumps: DataFrame, dataset: list[str], cols: list[str], out: str = "prediction") -> DataFrame:
    """Class with the largest summed say, ties to the smallest label."""
    d = rows.join(broadcast_checked(stumps, 4096), dataset)
    said = F.transform("stumps", lambda t: F.struct(_leaf_of(t, cols).alias("c"), t["alpha"].alias("a")))
    d = d.withColumn("_said", said)
    names = F.array_sort(F.array_distinct(F.transform("_said", lambda t: t["c"])))
    score = lambda v: F.aggregate("_said", F.lit(0.0), lambda s, t: s + F.when(t["c"] == v, t["a"]).otherwise(F.lit(0.0)))
    d = d.withColumn("_scores", F.transform(names, lambda v: F.struct(score(v).alias("s"), v.alias("c"))))
    best = F.aggregate("_scores", F.get("_scores", F.lit(0)), lambda b, c: F.when(c["s"] > b["s"], c).otherwise(b))
    return d.withColumn(out, F.coalesce(best["c"], F.col("common"))).drop("_said", "_scores", "stumps", "common", "open")
