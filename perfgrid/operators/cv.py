"""Cross-validation of many (dataset, fold, config) triples in one job."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfgrid.functions.metrics import ber_of_counts
from perfgrid.operators import gnb
from perfgrid.operators.prep import to_long
from perfgrid.operators.ranking import left_out_medians
from perfgrid.session import cut

# The configurations with exact, batched training: every preparation that maps
# moments to moments, followed by Gaussian naive Bayes.
REDUCERS = [(None, None), ("VarianceThreshold", None), ("SelectKBest", 0.25), ("SelectKBest", 0.5), ("SelectKBest", 0.75)]
FAMILY = [
    {"config_id": i, "imputer": imp, "scale": scale, "reducer": red, "share": share}
    for i, (imp, scale, (red, share)) in enumerate(product(["mean", "median", "most_frequent", "constant"], [False, True], REDUCERS))
]


def train_fills(rows: DataFrame, dataset: list[str], cols: list[str], strategy: str, k: int) -> DataFrame | None:
    """(dataset, outer, feature, fill) over the training rows of each left-out fold.

    Means come from the moments. Medians and modes do not subtract: counts per
    distinct value and fold are taken first, then combined per left-out fold.
    """
    if strategy == "mean":
        return None
    keys = [*dataset, "outer", "feature"]
    if strategy == "constant":
        have = rows.select(*dataset).distinct()
        have = have.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        return have.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in cols]))).withColumn("fill", F.lit(0.0))
    if strategy == "median":
        return left_out_medians(rows, dataset, cols, k, "fill")
    long = to_long(rows.select(*dataset, "fold", *[F.col(c).cast("double").alias(c) for c in cols]), [*dataset, "fold"], cols).filter("value is not null")
    outer = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    if strategy == "most_frequent":
        counts = long.groupBy(*dataset, "fold", "feature", "value").agg(F.count(F.lit(1)).alias("_n"))
        train = counts.withColumn("outer", outer).filter("fold <> outer")
        total = train.groupBy(*keys, "value").agg(F.sum("_n").alias("_n"))
        return total.groupBy(*keys).agg(F.min_by("value", F.struct(-F.col("_n"), F.col("value"))).alias("fill"))
    raise ValueError(f"unknown imputation strategy {strategy}")


def family_models(rows: DataFrame, dataset: list[str], label: str, cols: list[str], configs: list[dict], k: int) -> DataFrame:
    """Models of all given configs in one plan.

    The rows are scanned once for moments and once per imputation strategy that
    needs more than moments. Everything after works on the small moment table, in
    which the configs are rows, not separate jobs.
    """
    base = cut(gnb.class_moments(rows, dataset, label, cols, k))
    filled = None
    for strategy in dict.fromkeys(c["imputer"] for c in configs):
        one = gnb.with_fill(base, dataset, train_fills(rows, dataset, cols, strategy, k)).withColumn("imputer", F.lit(strategy))
        filled = one if filled is None else filled.unionByName(one)
    params = [
        F.struct(
            F.lit(c["config_id"]).alias("config_id"), F.lit(c["imputer"]).alias("imputer"), F.lit(c["scale"]).alias("scale"),
            F.lit(c["reducer"]).cast("string").alias("reducer"), F.lit(int(c["share"] * len(cols)) if c["share"] else 0).alias("k"),
        )
        for c in configs
    ]
    d = filled.withColumn("_p", F.explode(F.array(*params))).filter("_p.imputer = imputer")
    d = d.select(*[F.col(c) for c in d.columns if c not in ("_p", "imputer")], "_p.config_id", "_p.scale", "_p.reducer", "_p.k")
    keys = [*dataset, "config_id"]
    d = cut(gnb.scaled(d, keys, F.col("scale")))
    return gnb.models(gnb.reduced(d, keys, F.col("reducer"), F.col("k")), keys)


def cv_counts(
    rows: DataFrame, dataset: list[str], label: str, cols: list[str], configs: list[dict], k: int = 5, tasks: DataFrame | None = None
) -> DataFrame:
    """Out-of-fold counts of labels and predictions of every (dataset, config), or of the listed tasks only."""
    models = family_models(rows, dataset, label, cols, configs, k)
    if tasks is not None:
        models = models.join(tasks.select(*dataset, "config_id").distinct(), [*dataset, "config_id"], "left_semi")
    return gnb.predicted_counts(rows, cut(models), dataset, cols, label)


def work_units(config: Column, n_rows: Column, n_features: int) -> Column:
    """Deterministic cost: cells read, more for strategies that count values, and
    less for reduced features; wall time would differ from run to run."""
    return config * n_rows * F.lit(n_features / 1e4)


def config_weights(configs: list[dict]) -> Column:
    """Relative work of each config as a literal map."""
    weight = {"mean": 1.0, "median": 3.0, "most_frequent": 2.0, "constant": 0.8}
    pairs = []
    for c in configs:
        w = weight[c["imputer"]] + (0.3 if c["scale"] else 0.0) + (0.5 * (c["share"] or 1.0))
        pairs += [F.lit(c["config_id"]), F.lit(w)]
    return F.create_map(*pairs)


def perf_table(
    rows: DataFrame, dataset: list[str], label: str, cols: list[str], configs: list[dict], k: int = 5,
    done: DataFrame | None = None, tasks: DataFrame | None = None,
) -> DataFrame:
    """(dataset, config, error, runtime, status) of every task that is not done yet.

    A config whose preparation leaves no feature has no model and is recorded as
    invalid instead of failing the job.
    """
    sizes = rows.groupBy(*dataset).agg(F.count(F.lit(1)).alias("_n"))
    if tasks is None:
        tasks = sizes.select(*dataset).withColumn("config_id", F.explode(F.array(*[F.lit(c["config_id"]) for c in configs])))
    if done is not None:
        tasks = tasks.join(done.select(*dataset, "config_id"), [*dataset, "config_id"], "left_anti")
    errors = cv_errors(cv_counts(rows, dataset, label, cols, configs, k, tasks), [*dataset, "config_id"])
    cost = work_units(config_weights(configs)[F.col("config_id")], F.col("_n"), len(cols))
    out = tasks.join(sizes, dataset).join(errors, [*dataset, "config_id"], "left")
    status = F.when(F.col("error").isNull(), "invalid").otherwise("ok")
    return out.select(*dataset, "config_id", "error", cost.alias("runtime"), status.alias("status"))


def cv_errors(counts: DataFrame, keys: list[str]) -> DataFrame:
    return ber_of_counts(counts, [*keys, "fold"], "error").groupBy(*keys).agg(F.avg("error").alias("error"))

