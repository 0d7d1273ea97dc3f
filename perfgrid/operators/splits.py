"""Stratified folds, samples and hold-outs over many datasets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfgrid.operators.ranking import hash_rank
from perfgrid.session import attach, broadcast_checked, cut


def stratified_folds(
    df: DataFrame, dataset: str, label: str, order: str, ties: list[str] = (), k: int = 5, stratify: bool = True
) -> DataFrame:
    """Adds ``fold`` in 0..k-1; class sizes per fold differ by at most one.

    ``stratify=False`` gives plain folds, the right choice for a numeric target.
    """
    groups = [dataset, label] if stratify else [dataset]
    ranked = hash_rank(df, groups, order, ties, rank="_r")
    return ranked.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def stratified_sample(
    df: DataFrame,
    dataset: str,
    label: str,
    order: str,
    n_features: int,
    ties: list[str] = (),
    min_rows: int = 10000,
    ratio: int = 100,
    ceiling: int = 5000,
) -> DataFrame:
    """Down-samples only datasets that are large and much taller than wide.

    Every class keeps the same fraction (half-to-even rounding).
    """
    ranked = hash_rank(df, [dataset, label], order, ties, rank="_r", size="_nc")
    sizes = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("_n"))
    target = float(int(min(ceiling, ratio * n_features)))
    large = (F.col("_n") > min_rows) & (F.col("_n") / F.lit(n_features) > ratio)
    keep = F.when(large, F.rint(F.lit(target) / F.col("_n") * F.col("_nc"))).otherwise(F.col("_nc").cast("double"))
    return attach(ranked, sizes, [dataset], 64).filter(F.col("_r") <= keep).drop("_r", "_nc", "_n")


def _train_quota(counts: DataFrame, dataset: list[str], label: str, test_share: float) -> DataFrame:
    """Training rows per class: floors first, the rest to the largest remainders."""
    w = Window.partitionBy(*dataset)
    d = counts.withColumn("_n", F.sum("_nc").over(w)).withColumn("_test", F.ceil(F.col("_n") * F.lit(test_share)).cast("bigint"))
    d = d.withColumn("_train", F.col("_n") - F.col("_test"))
    classes = F.count(F.lit(1)).over(w)
    d = d.withColumn(
        "_ok", (F.min("_nc").over(w) >= 2) & (F.col("_test") >= classes) & (F.col("_train") >= classes)
    )
    d = d.withColumn("_share", F.col("_nc") * F.col("_train"))
    d = d.withColumn("_floor", F.expr("_share div _n")).withColumn("_rest", F.col("_share") % F.col("_n"))
    extra = F.col("_train") - F.sum("_floor").over(w)
    place = F.row_number().over(w.orderBy(F.col("_rest").desc(), F.col(label)))
    return d.withColumn("_quota", F.col("_floor") + F.when(place <= extra, 1).otherwise(0)).select(
        *dataset, label, "_ok", "_quota", "_train"
    )


def holdout(
    df: DataFrame, dataset: list[str], label: str, order: str, ties: list[str] = (), test_share: float = 0.15, out: str = "part"
) -> DataFrame:
    """85/15 split per dataset, stratified unless some class is too small for it."""
    counts = df.groupBy(*dataset, label).agg(F.count(F.lit(1)).alias("_nc"))
    quota = _train_quota(counts, dataset, label, test_share)
    tagged = attach(df, quota, [*dataset, label], 128).withColumn("_stratum", F.when(F.col("_ok"), F.col(label).cast("string")).otherwise("*"))
    ranked = hash_rank(tagged, [*dataset, "_stratum"], order, ties, rank="_r")
    limit = F.when(F.col("_ok"), F.col("_quota")).otherwise(F.col("_train"))
    return ranked.withColumn(out, F.when(F.col("_r") <= limit, "train").otherwise("test")).drop(
        "_ok", "_quota", "_train", "_stratum", "_r"
    )


def nested_split(df: DataFrame, dataset: str, label: str, order: str, ties: list[str] = (), k: int = 5) -> DataFrame:
    """For every outer fold: its rows are ``test``; the others split into ``train``/``valid``."""
    ranked = hash_rank(df, [dataset, label], order, ties, rank="_r")
    rows = ranked.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    # A class of n rows has (n - outer + k - 1) div k of them in a fold, and as many of the first r rows: the ranks among
    # the training rows follow from those among all rows.
    counts = df.dropna(subset=[dataset, label, order]).groupBy(dataset, label).agg(F.count(F.lit(1)).alias("_all"))
    counts = counts.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    counts = counts.select(dataset, "outer", label, F.expr(f"_all - (_all - outer + {k - 1}) div {k}").alias("_nc")).filter("_nc > 0")
    quota = cut(_train_quota(counts, [dataset, "outer"], label, 0.15))
    place = F.expr(f"_r - (_r - outer + {k - 1}) div {k}")
    part = F.when(F.col("fold") == F.col("outer"), "test").when(place <= F.col("_quota"), "train").otherwise("valid")
    good = rows.join(broadcast_checked(quota.filter("_ok").drop("_ok", "_train"), 128), [dataset, "outer", label], "left")
    good = good.withColumn("part", F.when((F.col("fold") == F.col("outer")) | F.col("_quota").isNotNull(), part))
    names = [*df.columns, "fold", "outer", "part"]
    if quota.filter("NOT _ok").isEmpty():
        return good.select(*names)
    rest = good.filter("part IS NULL").select(*df.columns, "fold", "outer")  # some class is too small: drawn from all classes
    rest = holdout(rest, [dataset, "outer"], label, order, ties)
    rest = rest.withColumn("part", F.when(F.col("part") == "test", "valid").otherwise(F.col("part")))
    return good.filter("part IS NOT NULL").select(*names).unionByName(rest.select(*names))


def constant_folds(df: DataFrame, dataset: str, label: str, k: int = 5) -> DataFrame:
    """Per (dataset, left-out fold): number of classes among the training rows and,
    when there is one only, the constant to predict."""
    seen = df.groupBy(dataset, label, "fold").agg(F.count(F.lit(1)).alias("_n"))
    outer = seen.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter("fold <> outer")
    classes = outer.groupBy(dataset, "outer", label).agg(F.sum("_n").alias("_n"))
    return classes.groupBy(dataset, "outer").agg(
        F.count(F.lit(1)).alias("n_classes"), F.when(F.count(F.lit(1)) == 1, F.min(label)).alias("constant")
    )
