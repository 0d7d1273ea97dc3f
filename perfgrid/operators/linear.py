"""Linear one-vs-rest learners for all datasets and left-out folds together.

Every epoch is one aggregate over the rows: each row meets the (small) weight
table of its dataset, and only per-model gradient sums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfgrid.operators import gnb
from perfgrid.session import broadcast_checked, cut


def _start(rows: DataFrame, dataset: list[str], label: str, cols: list[str], k: int | None, scale: bool) -> DataFrame:
    """(dataset, outer, label, n, fill, shift, sd, w): zero weights, bias first."""
    stats = gnb.scaled(gnb.with_fill(gnb.class_moments(rows, dataset, label, cols, k), dataset, None), dataset, scale)
    per = stats.groupBy(*dataset, "outer", "label").agg(
        F.max("n_all").alias("n_class"), F.collect_list(F.struct("feature", "fill", "shift", "sd")).alias("_q")
    )
    arrays = {f: gnb.aligned(F.col("_q"), cols, f, 1.0 if f == "sd" else 0.0) for f in ("fill", "shift", "sd")}
    zeros = F.array(*[F.lit(0.0)] * (len(cols) + 1))
    total = F.sum("n_class").over(Window.partitionBy(*dataset, "outer"))
    return per.withColumns(arrays).withColumn("n", total).withColumn("w", zeros).drop("n_class", "_q")


def _score(w, xs: list[str]):
    total = F.get(w, F.lit(0))
    for j, x in enumerate(xs):
        total = total + F.get(w, F.lit(j + 1)) * F.col(x)
    return total


def _pull(loss: str, y, s):
    """Minus the derivative of the loss along y * score."""
    if loss == "perceptron":
        return F.when(y * s <= 0, F.lit(1.0)).otherwise(F.lit(0.0))
    if loss == "logistic":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(y * s))
    if loss == "squared_hinge":
        return F.lit(2.0) * F.greatest(F.lit(1.0) - y * s, F.lit(0.0))
    raise ValueError(f"unknown loss {loss}")


def epoch_sums(rows: DataFrame, state: DataFrame, dataset: list[str], label: str, cols: list[str], loss: str) -> DataFrame:
    """Sum over the training rows of pull * y * (1, x) per (dataset, outer, label)."""
    model = F.struct("outer", F.col("label").alias("c"), "fill", "shift", "sd", "w")
    packed = state.groupBy(*dataset).agg(F.collect_list(model).alias("_models"))
    fold = F.col("fold") if "fold" in rows.columns else F.lit(-2)
    d = rows.select(*dataset, F.col(label).alias("_y"), fold.alias("_f"), *cols)
    packed = broadcast_checked(cut(packed), 4096)
    d = d.join(packed, dataset).withColumn("m", F.explode("_models")).filter("m.outer <> _f").drop("_models")
    xs = [f"_x{j}" for j in range(len(cols))]
    d = d.withColumns(dict(zip(xs, gnb.prepared(cols, F.col("m.fill"), F.col("m.shift"), F.col("m.sd")))))
    sign = F.when(F.col("_y") == F.col("m.c"), F.lit(1.0)).otherwise(F.lit(-1.0))
    d = d.withColumn("_s", _score(F.col("m.w"), xs)).withColumn("_sign", sign)
    d = d.withColumn("_g", _pull(loss, F.col("_sign"), F.col("_s")) * F.col("_sign"))
    sums = F.array(F.sum("_g"), *[F.sum(F.col("_g") * F.col(x)) for x in xs])
    return d.groupBy(*dataset, F.col("m.outer").alias("outer"), F.col("m.c").alias("label")).agg(sums.alias("g"))


def fit(
    rows: DataFrame, dataset: list[str], label: str, cols: list[str], loss: str = "perceptron", k: int | None = 5,
    epochs: int = 5, c: float = 1.0, penalty: str = "l2", scale: bool = True,
) -> DataFrame:
    """Weights (dataset, outer, label, preparation, w) after full-batch epochs.

    Perceptron adds every misclassified row. Logistic and squared hinge take proximal
    gradient steps on mean loss + penalty / (C n); the bias is not penalized.
    """
    state = cut(_start(rows, dataset, label, cols, k, scale))
    width = len(cols) + 1
    rate = {"perceptron": 1.0, "logistic": 4.0 / width, "squared_hinge": 0.5 / width}[loss]
    for _ in range(epochs):
        g = epoch_sums(rows, state, dataset, label, cols, loss)
        d = state.join(g, [*dataset, "outer", "label"], "left")
        per_row = F.lit(1.0) if loss == "perceptron" else F.lit(1.0) / F.col("n")
        stepped = F.zip_with("w", F.coalesce("g", "w"), lambda w, s: w + F.when(F.col("g").isNull(), 0.0).otherwise(s * per_row * F.lit(rate)))
        if loss != "perceptron":
            shrink = F.lit(rate / c) / F.col("n")
            if penalty == "l1":
                prox = lambda v: F.signum(v) * F.greatest(F.abs(v) - shrink, F.lit(0.0))
            else:
                prox = lambda v: v / (F.lit(1.0) + shrink)
            stepped = F.transform(stepped, lambda v, i: F.when(i == 0, v).otherwise(prox(v)))
        state = cut(d.withColumn("w", stepped).drop("g"))
    return state


def predict(rows: DataFrame, state: DataFrame, dataset: list[str], cols: list[str], out: str = "prediction") -> DataFrame:
    """Class of the largest score, ties to the smallest label."""
    packed = state.groupBy(*dataset, "outer").agg(
        F.array_sort(F.collect_list(F.struct("label", "w"))).alias("_classes"), *[F.first(f).alias(f"_{f}") for f in ("fill", "shift", "sd")]
    )
    d = rows.withColumn("outer", F.col("fold") if "fold" in rows.columns else F.lit(gnb.WHOLE))
    d, n = gnb.join_models(d, packed, [*dataset, "outer"], len(cols))
    xs = [f"_x{j}" for j in range(len(cols))]
    d = d.withColumns(dict(zip(xs, gnb.prepared(cols, F.col("_fill"), F.col("_shift"), F.col("_sd")))))
    label = gnb.best_label("_classes", n, lambda m: _score(m["w"], xs))
    return d.withColumn(out, label).drop("_classes", "_fill", "_shift", "_sd", "outer", *xs)


def ridge(rows: DataFrame, groups: list[str], x: str, y: str, alpha: float) -> DataFrame:
    """One-feature ridge with free intercept, closed form from covariance sums."""
    s = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("cxx"), F.avg(x).alias("mx"), F.avg(y).alias("my")
    )
    slope = F.col("n") * F.col("cxy") / (F.col("n") * F.col("cxx") + F.lit(alpha))
    return s.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).select(*groups, "slope", "intercept")
