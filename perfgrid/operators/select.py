"""Filtering, ranking and budgeted picking of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfgrid.functions.scalars import hash_order
from perfgrid.operators.ranking import grouped_quantile, running_prefix, top_k


def mean_fold_error(fold_errors: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """Mean of the fold errors (not of pooled rows) per key."""
    return fold_errors.groupBy(*keys).agg((F.round(F.avg(error), 6) + 0.0).alias("cv_error"), F.count(error).alias("n_folds"))


def filter_configs(
    perf: DataFrame, algorithms: list[str] | None = None, hyperparameters: dict[str, dict[str, list[str]]] | None = None
) -> DataFrame:
    """Configs of the named algorithms whose listed hyperparameters have allowed values.

    Hyperparameters that the filter does not mention are free.
    """
    if algorithms is None and hyperparameters is None:
        raise ValueError("name algorithms or hyperparameters")
    cond = F.lit(True) if algorithms is None else F.col("algorithm").isin(algorithms)
    for algorithm, allowed in (hyperparameters or {}).items():
        for name, values in allowed.items():
            have = F.col("hyperparameters")[name]
            fits = have.isNull() | have.isin([str(v) for v in values])
            cond = cond & ((F.col("algorithm") != algorithm) | fits)
    return perf.filter(cond)


def affordable(perf: DataFrame, limit: Column, cost: str = "runtime") -> DataFrame:
    return perf.filter(F.col(cost) <= limit)


def valid_errors(perf: DataFrame) -> DataFrame:
    """Errors of failed runs become missing; the status says why."""
    return perf.withColumn("error", F.when(F.col("status") == "ok", F.col("error")))


def best_on_average(perf: DataFrame, config: str = "config_id") -> DataFrame:
    """Config of least mean error over the datasets it was measured on."""
    mean = perf.groupBy(config).agg(F.avg("error").alias("mean_error"))
    return mean.orderBy("mean_error", config).limit(1)


def median_top(perf: DataFrame, share: float = 0.02, limit: float | None = None, config: str = "config_id") -> DataFrame:
    """Share of the configs with least median error that are also affordable."""
    med = grouped_quantile(perf, [config], "error", 0.5, "median_error")
    cost = perf.groupBy(config).agg(F.avg("runtime").alias("cost"), F.count("error").alias("_c"))
    ranked = med.join(cost, config)
    w = Window.orderBy("median_error", config)  # one row per config: the grid's length
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    ranked = ranked.withColumn("_r", F.row_number().over(w)).withColumn("_m", m)
    ranked = ranked.filter(F.col("_r") <= F.floor(F.col("_m") * F.lit(share)))
    if limit is not None:
        ranked = ranked.filter(F.col("cost") <= limit)
    return ranked.select(config, "median_error")


def cheapest_prefix(perf: DataFrame, limit: Column, cost: str = "runtime") -> DataFrame:
    """Cheapest configs per dataset until the first that does not fit."""
    return running_prefix(perf, ["dataset_id"], cost, [F.col(cost), F.col("config_id")], limit)


def rank_configs(perf: DataFrame, k: int, error: str = "error") -> DataFrame:
    """Best k configs per dataset, unmeasured ones last, ties by id."""
    return top_k(perf, ["dataset_id"], [F.col(error).asc_nulls_last(), F.col("config_id")], k, "place")


def budget_pick(candidates: DataFrame, budget: Column, order: list[str], cost: str = "cost") -> DataFrame:
    """Per dataset, walk the configs in order and take each one that still fits.

    A config that does not fit is skipped, later ones may still be taken, so the
    walk is a fold over the dataset's ordered configs. A dataset has at most one
    row per config, so the array is as long as the grid, whatever the data size.
    """
    item = F.struct(*[F.col(c) for c in order], F.col("config_id"), F.col(cost).alias("cost"))
    packed = candidates.withColumn("_budget", budget).groupBy("dataset_id").agg(
        F.array_sort(F.collect_list(item)).alias("_items"), F.max("_budget").alias("_budget")
    )
    id_type = candidates.schema["config_id"].dataType.simpleString()
    start = F.struct(F.lit(0.0).alias("spent"), F.array().cast(f"array<struct<config_id:{id_type},spent:double>>").alias("taken"))

    def step(acc, x):
        total = acc["spent"] + x["cost"]
        fits = total <= F.col("_budget")
        got = F.array(F.struct(x["config_id"].alias("config_id"), total.alias("spent")))
        return F.struct(
            F.when(fits, total).otherwise(acc["spent"]).alias("spent"),
            F.when(fits, F.concat(acc["taken"], got)).otherwise(acc["taken"]).alias("taken"),
        )

    walked = packed.withColumn("_w", F.aggregate("_items", start, step))
    return walked.select("dataset_id", F.posexplode("_w.taken").alias("place", "t")).select(
        "dataset_id", (F.col("place") + 1).cast("bigint").alias("place"), "t.config_id", "t.spent"
    )


def random_affordable(
    perf: DataFrame, measured: DataFrame, limit: Column, n: int, seed: int = 0, cost: str = "runtime"
) -> DataFrame:
    """n unmeasured affordable configs per dataset in seeded random order; the
    cheapest config where none is affordable."""
    keys = ["dataset_id", "config_id"]
    fit = affordable(perf, limit, cost).join(measured.select(*keys), keys, "left_anti")
    fit = fit.withColumn("_h", hash_order(seed, *keys))
    chosen = top_k(fit, ["dataset_id"], [F.col("_h"), F.col("config_id")], n).select(*keys)
    cheapest = perf.groupBy("dataset_id").agg(F.min_by("config_id", F.struct(cost, "config_id")).alias("config_id"))
    return chosen.unionByName(cheapest.join(chosen.select("dataset_id"), "dataset_id", "left_anti"))
