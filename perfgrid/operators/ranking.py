"""Ranks, prefixes, medians and modes that keep no whole group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfgrid.session import attach, cut, partitions


WHOLE_GROUP = 100_000  # rows of a group that one task may sort


def _digits(df: DataFrame) -> int:
    """Hex digits of the sub-range key: at least four sub-ranges per shuffle partition."""
    return max(1, math.ceil(math.log(4 * partitions(df.sparkSession), 16)))


def hash_rank(
    df: DataFrame,
    groups: list[str],
    order: str,
    ties: list[str] = (),
    rank: str = "rank",
    size: str | None = None,
) -> DataFrame:
    """Exact 1-based rank inside each group, ordered by a hex hash column.

    A group may hold a third of all rows, so it is cut into sub-ranges by the
    leading digits of the hash (even by construction). Rows are ranked inside a
    sub-range and shifted by the counts of the sub-ranges before it. ``size``
    names an optional column with the group's row count. Groups that are many and
    of bounded length are ranked whole: cut up, they would be nearly as many sub-ranges as rows.
    """
    by_group = Window.partitionBy(*groups)
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("groups"), F.max("_n").alias("largest")).first()
    if sizes.groups >= 16 * partitions(df.sparkSession) and sizes.largest <= WHOLE_GROUP:
        d = df.dropna(subset=[*groups, order])
        if size:
            d = d.withColumn(size, F.count(F.lit(1)).over(by_group))
        return d.withColumn(rank, F.row_number().over(by_group.orderBy(order, *ties)).cast("bigint"))
    d = df.withColumn("_sub", F.substring(order, 1, _digits(df)))
    counts = d.groupBy(*groups, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = by_group.orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if size:
        counts = counts.withColumn(size, F.sum("_n").over(by_group))
    counts = counts.drop("_n")
    inside = Window.partitionBy(*groups, "_sub").orderBy(order, *ties)
    ranked = d.withColumn("_in", F.row_number().over(inside)).join(counts, [*groups, "_sub"])
    return ranked.withColumn(rank, (F.col("_shift") + F.col("_in")).cast("bigint")).drop("_sub", "_in", "_shift")


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table (an ungrouped aggregate) to every row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group; map tasks keep k rows per group before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))


def grouped_mode(df: DataFrame, groups: list[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent non-NULL value per group, ties to the smallest; two-level count."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*groups).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def grouped_quantile(
    df: DataFrame, groups: list[str], value: str, q: float = 0.5, out: str = "quantile", accuracy: int = 10000
) -> DataFrame:
    """Exact (linearly interpolated) quantile per group without sorting the group.

    A mergeable sketch brackets the wanted rank; one more pass counts the rows
    below the bracket and the distinct values inside it (a few 1/accuracy of the
    group), and only those are ordered.
    """
    slack = 2.0 / accuracy
    d = df.filter(F.col(value).isNotNull())
    lo_hi = F.percentile_approx(value, F.array(F.lit(max(0.0, q - slack)), F.lit(min(1.0, q + slack))), accuracy)
    sketch = d.groupBy(*groups).agg(lo_hi.alias("_b"), F.count(F.lit(1)).alias("_total"))
    joined = attach(d, sketch, groups, 128) if groups else with_constants(d, sketch)
    lo, hi = F.col("_b")[0], F.col("_b")[1]
    inside = (
        joined.filter(F.col(value) <= F.when(F.lit(q) + slack >= 1.0, F.col(value)).otherwise(hi))
        .withColumn("_v", F.when(F.col(value) >= lo, F.col(value)))
        .groupBy(*groups, "_total", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return _at_rank(inside, groups, q, out)


def _at_rank(inside: DataFrame, groups: list[str], q: float, out: str) -> DataFrame:
    """Quantile of each group from counts (groups, _total, _v, _n); the values below the bracket are one line without _v."""
    order = Window.partitionBy(*groups).orderBy(F.col("_v").asc_nulls_first())
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = F.lit(q) * (F.col("_total") - 1)
    low_rank, high_rank = F.floor(at) + 1, F.ceil(at) + 1
    ranged = inside.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_n") + 1)
    holds = lambda r: (F.col("_from") <= r) & (r <= F.col("_to"))
    low = F.max(F.when(holds(low_rank), F.col("_v")))
    high = F.max(F.when(holds(high_rank), F.col("_v")))
    part = F.max(at - F.floor(at))
    return ranged.groupBy(*groups).agg((low + (high - low) * part).alias(out))


def left_out_medians(df: DataFrame, groups: list[str], cols: list[str], k: int, out: str = "quantile", accuracy: int = 10000, width: int = 8) -> DataFrame:
    """(groups, outer, feature, median) of the rows outside each of k folds, as :func:`grouped_quantile` finds it. Folds and
    features are columns of an aggregate, ``width`` features a scan, so rows are not repeated for each left-out fold."""
    slack, found = 2.0 / accuracy, None
    for a in range(0, len(cols), width):
        some = cols[a : a + width]
        d = df.select(*groups, "fold", *[F.col(c).cast("double").alias(c) for c in some])
        cells = [(o, c, F.when(F.col("fold") != o, F.col(c))) for o in range(k) for c in some]
        lo_hi = F.array(F.lit(0.5 - slack), F.lit(0.5 + slack))
        aggs = [x for i, (_, _, v) in enumerate(cells) for x in (F.percentile_approx(v, lo_hi, accuracy).alias(f"_b{i}"), F.count(v).alias(f"_t{i}"))]
        joined = attach(d, cut(d.groupBy(*groups).agg(*aggs)), groups, 32 * len(cells))
        one = lambda i, o, c, v, n: F.struct(F.lit(o).alias("outer"), F.lit(c).alias("feature"), F.col(f"_t{i}").alias("_total"), v.alias("_v"), n.alias("_n"))
        near = [F.when(v.between(F.col(f"_b{i}")[0], F.col(f"_b{i}")[1]), one(i, o, c, v, F.lit(1).cast("long"))) for i, (o, c, v) in enumerate(cells)]
        near = joined.select(*groups, F.explode(F.filter(F.array(*near), lambda e: e.isNotNull())).alias("_e")).select(*groups, "_e.*")
        near = near.groupBy(*groups, "outer", "feature", "_total", "_v").agg(F.sum("_n").alias("_n"))
        below = joined.groupBy(*groups).agg(*[x for i, (_, _, v) in enumerate(cells) for x in (F.count_if(v < F.col(f"_b{i}")[0]).alias(f"_n{i}"), F.max(f"_t{i}").alias(f"_t{i}"))])
        listed = F.array(*[one(i, o, c, F.lit(None).cast("double"), F.col(f"_n{i}")) for i, (o, c, _) in enumerate(cells)])
        below = below.select(*groups, F.explode(listed).alias("_e")).select(*groups, "_e.*").filter("_n > 0")
        part = _at_rank(near.unionByName(below), [*groups, "outer", "feature"], 0.5, out)
        found = part if found is None else found.unionByName(part)
    return found


def running_prefix(df: DataFrame, groups: list[str], cost: str, order: list[Column], limit: Column, out: str = "spent") -> DataFrame:
    """Longest prefix (in the given order) whose running cost stays within the limit."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(cost).over(w)).filter(F.col(out) <= limit)


def prefix_sums(df: DataFrame, groups: list[str], order: list[str], sums: list[str], suffix: str = "_upto") -> DataFrame:
    """Running sums in (groups, order) without putting a group into one task.

    Rows are range-partitioned on groups and order, so a large group spans many
    partitions. The partitioned rows are checkpointed (range bounds are sampled and
    must not be drawn twice), summed inside each partition, and shifted by the
    totals of the group's earlier partitions.
    """
    ranged = df.repartitionByRange(*groups, *order).withColumn("_pid", F.spark_partition_id())
    ranged = cut(ranged)
    totals = ranged.groupBy(*groups, "_pid").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*groups, "_pid", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_s_{s}") for s in sums])
    inside = Window.partitionBy(*groups, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(s).over(inside).alias(f"_i_{s}") for s in sums]).join(shifts, [*groups, "_pid"])
    out = out.withColumns({f"{s}{suffix}": F.col(f"_i_{s}") + F.col(f"_s_{s}") for s in sums})
    return out.drop("_pid", *[f"_i_{s}" for s in sums], *[f"_s_{s}" for s in sums])
