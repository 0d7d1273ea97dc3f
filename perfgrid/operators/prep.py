"""Feature preparation: fit is an aggregate, transform a projection.

Every fit is grouped (by dataset, or by dataset and left-out fold), so all
datasets and folds are prepared in the same jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfgrid.operators.ranking import grouped_mode, grouped_quantile
from perfgrid.session import attach, cut


def to_long(df: DataFrame, keys: list[str], cols: list[str], value: str = "value") -> DataFrame:
    """One row per (row, feature) for fits that cannot be done column by column."""
    return df.select(*keys, *cols).unpivot(keys, cols, "feature", value)


def moments(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, feature, n_all, n, mean, var): all features in one map-side combined pass."""
    aggs = [F.count(F.lit(1)).alias("n_all")]
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_m{i}"), F.var_pop(x).alias(f"_v{i}")]
    per = [
        F.struct(
            F.lit(c).alias("feature"), F.col(f"_n{i}").alias("n"), F.col(f"_m{i}").alias("mean"), F.col(f"_v{i}").alias("var")
        )
        for i, c in enumerate(cols)
    ]
    flat = df.groupBy(*keys).agg(*aggs).select(*keys, "n_all", F.explode(F.array(*per)).alias("s"))
    return flat.select(*keys, "s.feature", "n_all", "s.n", "s.mean", "s.var")


def pool(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merges moments of disjoint parts (stable: squared deviations from the pooled mean)."""
    w = Window.partitionBy(*keys)
    n = F.sum("n").over(w)
    d = parts.withColumn("_m", F.try_divide(F.sum(F.col("n") * F.coalesce("mean", F.lit(0.0))).over(w), n))
    gap = F.col("mean") - F.col("_m")
    spread = F.sum(F.col("n") * F.coalesce(F.col("var") + gap * gap, F.lit(0.0)))
    return d.groupBy(*keys).agg(
        F.sum("n_all").alias("n_all"), F.sum("n").alias("n"), F.max("_m").alias("mean"), F.try_divide(spread, F.sum("n")).alias("var")
    )


def leave_out(parts: DataFrame, keys: list[str], k: int, fold: str = "fold") -> DataFrame:
    """Moments of the training rows of every left-out fold from moments per fold:
    one scan serves all folds. ``outer`` is the fold left out."""
    others = parts.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter(F.col(fold) != F.col("outer"))
    return pool(others.drop(fold), [*keys, "outer"] if "outer" not in keys else keys)


def fill_values(df: DataFrame, groups: list[str], cols: list[str], strategy: str, constant: float = 0.0) -> DataFrame:
    """(groups, feature, fill): what replaces a missing number."""
    if strategy == "mean":
        return moments(df, groups, cols).select(*groups, "feature", F.col("mean").alias("fill"))
    if strategy == "constant":
        return moments(df, groups, cols).select(*groups, "feature", F.lit(constant).alias("fill"))
    long = to_long(df.select(*groups, *[F.col(c).cast("double").alias(c) for c in cols]), groups, cols)
    if strategy == "median":
        return grouped_quantile(long, [*groups, "feature"], "value", 0.5, "fill")
    if strategy == "most_frequent":
        return grouped_mode(long, [*groups, "feature"], "value", "fill")
    raise ValueError(f"unknown imputation strategy {strategy}")


def as_map(stats: DataFrame, groups: list[str], value: Column, name: str) -> DataFrame:
    """Feature statistics of a group as one map column (as long as the feature list)."""
    entry = F.struct(F.col("feature"), value)
    return stats.groupBy(*groups).agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def impute(df: DataFrame, groups: list[str], cols: list[str], strategy: str, constant: float = 0.0) -> DataFrame:
    """Fills missing numbers per group; columns without any value stay NULL unless constant."""
    fills = as_map(fill_values(df, groups, cols, strategy, constant), groups, F.col("fill"), "_fill")
    out = attach(df, fills, groups, 64 * (len(cols) + 1), "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("_fill")[c]) for c in cols}).drop("_fill")


def impute_category(df: DataFrame, groups: list[str], cols: list[str]) -> DataFrame:
    """Fills missing categories with the group's most frequent one."""
    for c in cols:
        df = attach(df, grouped_mode(df, groups, c, "_m"), groups, 128, "left").withColumn(c, F.coalesce(c, "_m")).drop("_m")
    return df


def impute_mixed(df: DataFrame, groups: list[str], categorical: list[str], numeric: list[str], keep: list[str] = ()) -> DataFrame:
    """Most frequent for categories, mean for numbers; categories come first."""
    out = impute(impute_category(df, groups, categorical), groups, numeric, "mean")
    return out.select(*groups, *keep, *categorical, *numeric)


def categories(df: DataFrame, col: str, widest: int = 10_000) -> list:
    """Sorted categories of a column, after a check that they fit as columns."""
    found = df.filter(F.col(col).isNotNull()).select(col).distinct().limit(widest + 1).collect()
    if len(found) > widest:
        raise ValueError(f"{col} has more than {widest} categories: use one_hot_index")
    return sorted(r[0] for r in found)


def one_hot(df: DataFrame, cols: list[str], levels: dict[str, list] | None = None) -> DataFrame:
    """0/1 column per category; unknown or missing categories give zeros only."""
    for c in cols:
        values = (levels or {}).get(c) or categories(df, c)
        df = df.withColumns({f"{c}={v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for v in values}).drop(c)
    return df


def one_hot_index(df: DataFrame, col: str) -> DataFrame:
    """Sparse form for any number of categories: position of the single 1, joined
    from a distributed, sorted category table; NULL for unknown ones."""
    levels = df.filter(F.col(col).isNotNull()).select(col).distinct()
    ranged = cut(levels.repartitionByRange(col).sortWithinPartitions(col).withColumn("_p", F.spark_partition_id()))  # bounds are drawn once
    ranged = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(col)))
    per = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    start = per.withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    index = ranged.join(F.broadcast(start), "_p").select(col, (F.col("_s") + F.col("_r") - 1).alias(f"{col}_index"))
    return df.join(index, col, "left")


def scaling(stats: DataFrame) -> DataFrame:
    """Adds the divisor: population deviation, or 1 where it is 0."""
    sd = F.sqrt("var")
    return stats.withColumn("sd", F.when(sd > 0, sd).otherwise(F.lit(1.0)))


def standardize(df: DataFrame, groups: list[str], cols: list[str]) -> DataFrame:
    """Mean 0 and population variance 1 per group."""
    stats = scaling(moments(df, groups, cols))
    m = as_map(stats, groups, F.struct("mean", "sd"), "_scale")
    out = attach(df, m, groups, 96 * (len(cols) + 1))
    return out.withColumns({c: (F.col(c) - F.col("_scale")[c]["mean"]) / F.col("_scale")[c]["sd"] for c in cols}).drop("_scale")


def preprocess(
    df: DataFrame,
    groups: list[str],
    categorical: list[str],
    numeric: list[str],
    keep: list[str] = (),
    impute_missing: bool = True,
    scale: bool = True,
    encode: bool = True,
    levels: dict[str, list] | None = None,
) -> DataFrame:
    """Imputation, one-hot encoding and scaling, each behind its flag."""
    if impute_missing:
        df = impute_mixed(df, groups, categorical, numeric, keep)
    else:
        df = df.select(*groups, *keep, *categorical, *numeric)
    features = list(numeric)
    if encode and categorical:
        levels = levels or {c: categories(df, c) for c in categorical}
        df = one_hot(df, categorical, levels)
        features = [f"{c}={v}" for c in categorical for v in levels[c]] + features
        df = df.select(*groups, *keep, *features)
    return standardize(df, groups, features) if scale else df


def drop_empty(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drops columns without a single value: one aggregate decides for all of them."""
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if counts[c] == 0])


def varying(df: DataFrame, groups: list[str], cols: list[str], threshold: float = 0.0) -> DataFrame:
    """(groups, feature, var) of the features whose variance exceeds the threshold."""
    return moments(df, groups, cols).filter(F.col("var") > threshold).select(*groups, "feature", "var")


def anova_f_of(stats: DataFrame, groups: list[str]) -> DataFrame:
    """ANOVA F per feature from per-class moments (groups, label, feature, n, mean, var)."""
    w = Window.partitionBy(*groups, "feature")
    total = F.sum("n").over(w)
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / total
    d = stats.filter("n > 0").withColumn("_t", total).withColumn("_g", grand)
    gap = F.col("mean") - F.col("_g")
    between, within = F.sum(F.col("n") * gap * gap), F.sum(F.col("n") * F.col("var"))
    classes, rows = F.count(F.lit(1)), F.max("_t")
    f = F.try_divide(F.try_divide(between, classes - 1), F.try_divide(within, rows - classes))
    f = F.when((within == 0) & (between > 0), F.lit(float("inf"))).otherwise(f)  # perfect separation ranks first
    return d.groupBy(*groups, "feature").agg(f.alias("f"))


def anova_f(df: DataFrame, groups: list[str], label: str, cols: list[str]) -> DataFrame:
    return anova_f_of(moments(df, [*groups, label], cols), groups)


def select_k_best(df: DataFrame, groups: list[str], label: str, cols: list[str], k: int) -> DataFrame:
    """The k features of largest F per group, ties by name."""
    w = Window.partitionBy(*groups).orderBy(F.col("f").desc_nulls_last(), "feature")
    scored = anova_f(df, groups, label, cols).withColumn("place", F.row_number().over(w))
    return scored.filter(F.col("place") <= k).withColumn("place", F.col("place").cast("bigint"))
