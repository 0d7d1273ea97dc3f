"""Labelled tables, performance tables, result files and artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfgrid.functions.scalars import first_integer, stem
from perfgrid.operators.ranking import with_constants
from perfgrid.session import broadcast_checked, cut


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing at the edge only; inside it is always NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def load_labelled(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Headerless CSV files, last column = label, dataset id = first integer of the
    file name. The schema is given, so no pass is spent on inference."""
    names = schema.fieldNames()
    raw = spark.read.csv(path, schema=schema, header=False, nanValue="nan")
    raw = raw.withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    d = nan_to_null(raw.withColumnRenamed(names[-1], "label"))
    return d.withColumn("dataset_id", first_integer("_file")).withColumn("stem", stem("_file")).drop("_file")


def perf_unpivot(wide: DataFrame, id_col: str, value: str = "error", drop_missing: bool = True) -> DataFrame:
    """Wide performance matrix (one column per config heading) to long rows."""
    heads = [c for c in wide.columns if c != id_col]
    long = wide.unpivot([id_col], heads, "config", value).withColumn(value, F.col(value).cast("double"))
    long = long.withColumn(value, F.when(~F.isnan(value), F.col(value)))
    return long.filter(F.col(value).isNotNull()) if drop_missing else long


def perf_pivot(long: DataFrame, id_col: str, config: str, value: str, configs: list) -> DataFrame:
    """Long rows to a wide matrix; the heading list is given so no distinct pass runs."""
    return long.groupBy(id_col).pivot(config, configs).agg(F.first(value))


def dataset_sizes(rows: DataFrame, dataset: str, n_features: int, known: DataFrame | None = None) -> DataFrame:
    """(dataset, n_rows, n_features); only datasets absent from ``known`` are counted."""
    todo = rows.select(dataset) if known is None else rows.select(dataset).join(known.select(dataset), dataset, "left_anti")
    measured = todo.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_features", F.lit(n_features).cast("bigint"))
    return measured if known is None else known.select(dataset, "n_rows", "n_features").unionByName(measured)


def write_perf(perf: DataFrame, path: str) -> None:
    """Appends long performance rows, one folder per dataset."""
    perf.repartition("dataset_id").write.mode("append").partitionBy("dataset_id").parquet(path)


def complete_datasets(perf: DataFrame, dataset: str, n_configs: int | Column, values: list[str]) -> DataFrame:
    """Rows of datasets in which no expected cell is missing."""
    whole = F.lit(True)
    for v in values:
        whole = whole & (F.count(v) == n_configs)
    good = perf.groupBy(dataset).agg(whole.alias("_whole")).filter("_whole").select(dataset)
    return perf.join(good, dataset, "left_semi")


RESULT = "dataset_id string, config string, error double, runtime double"


def parse_results(text: DataFrame) -> DataFrame:
    """Result files read as (file, lines): header of config headings, one ``Error``
    and one ``Time`` row. Cells pair up by heading, so column order is free."""
    d = text.select(
        stem(
            F.coalesce(F.nullif(F.regexp_extract("path", r"name=([^/]*)/", 1), F.lit("")), F.element_at(F.split("path", "/"), -1))
        ).alias("dataset_id"),
        F.transform(F.split(F.rtrim("content"), r"\r?\n"), _cells).alias("rows"),
    )
    row = lambda name: F.filter("rows", lambda r: F.get(r, F.lit(0)) == name)[0]
    d = d.select("dataset_id", F.col("rows")[0].alias("head"), row("Error").alias("err"), row("Time").alias("tim"))
    cells = F.arrays_zip("head", "err", "tim")
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    return (
        d.select("dataset_id", F.posexplode(cells).alias("pos", "cell"))
        .filter("pos > 0")
        .select("dataset_id", F.col("cell.head").alias("config"), number("cell.err").alias("error"), number("cell.tim").alias("runtime"))
    )


def _cells(line: Column) -> Column:
    """Cells of one CSV line in one linear pass; commas inside quotes are kept."""
    pattern = r',("(?:[^"]++|"")*+"|[^,"]*+)'
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(pattern), F.lit(1))
    return F.transform(parts, lambda c: F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"')))


def read_result_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per result file; each holds two rows per dataset, so files are small."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def merge_status(done: DataFrame, arrived: DataFrame, headings: DataFrame) -> DataFrame:
    """(dataset_id, status) of arrived datasets: ``known`` when merged before, ``headings`` when
    theirs are not exactly the table's, ``conflict`` when two files of one dataset differ, ``missing``
    when a cell is empty, else ``new``. The order of arrival plays no part."""
    want = headings.select("config").distinct()
    n = want.groupBy().agg(F.count(F.lit(1)).alias("_want"))
    known = arrived.distinct().join(want.withColumn("_known", F.lit(1)), "config", "left")
    state = known.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_distinct("config").alias("_heads"),
        F.count_distinct(F.when(F.col("_known") == 1, F.col("config"))).alias("_fit"),
        F.sum(F.when(F.col("error").isNotNull() & F.col("runtime").isNotNull(), 0).otherwise(1)).alias("_empty"),
    )
    before = done.select("dataset_id").distinct().withColumn("_before", F.lit(1))
    return with_constants(state, n).join(before, "dataset_id", "left").select("dataset_id", _status().alias("status"))


def _status() -> Column:
    return (
        F.when(F.col("_before") == 1, "known")
        .when((F.col("_heads") != F.col("_want")) | (F.col("_fit") != F.col("_want")), "headings")
        .when(F.col("_rows") > F.col("_heads"), "conflict")
        .when(F.col("_empty") > 0, "missing")
        .otherwise("new")
    )


def by_dataset(arrived: DataFrame) -> DataFrame:
    """(dataset_id, cells): the different (config, error, runtime) of each dataset, as many as its files have. Zeros have no sign."""
    cell = F.struct("config", (F.col("error") + 0.0).alias("error"), (F.col("runtime") + 0.0).alias("runtime"))
    return arrived.groupBy("dataset_id").agg(F.collect_set(cell).alias("cells"))


def cells_of(datasets: DataFrame) -> DataFrame:
    """The rows of :func:`by_dataset` tables."""
    return datasets.select("dataset_id", F.inline("cells"))


def merge_status_by_dataset(done: DataFrame, datasets: DataFrame, headings: DataFrame) -> DataFrame:
    """:func:`merge_status` of a :func:`by_dataset` table beside its cells: datasets are settled where they are, without a
    shuffle of cells for each count. ``done`` names a dataset once."""
    want = headings.select("config").distinct().groupBy().agg(F.count(F.lit(1)).alias("_want"), F.collect_list("config").alias("_configs"))
    names = F.array_distinct(F.filter("cells.config", lambda c: c.isNotNull()))
    counts = {
        "_rows": F.size("cells"),
        "_heads": F.size(names),
        "_fit": F.size(F.array_intersect(names, "_configs")),
        "_empty": F.size(F.filter("cells", lambda c: c["error"].isNull() | c["runtime"].isNull())),
    }
    state = datasets.join(F.broadcast(want)).withColumns(counts).join(done.select("dataset_id", F.lit(1).alias("_before")), "dataset_id", "left")
    return state.select("dataset_id", "cells", _status().alias("status"))


def first_headings(arrived: DataFrame) -> DataFrame:
    """Headings of the smallest dataset id, for a table that has none yet."""
    least = arrived.groupBy().agg(F.min("dataset_id").alias("dataset_id"))
    return arrived.join(F.broadcast(least), "dataset_id", "left_semi").select("config").distinct()


def merge_rows(merged: DataFrame, arrived: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """Adds newly arrived complete datasets to the merged long table. Headings are those given,
    else those of the merged table, else those of the smallest arrived dataset id; ``merge_status``
    tells why a dataset stayed out."""
    if headings is None:
        headings = first_headings(arrived) if merged.isEmpty() else merged.select("config").distinct()
    fresh = merge_status(merged, arrived, headings).filter("status = 'new'")
    return merged.unionByName(arrived.distinct().join(fresh, "dataset_id", "left_semi").select(*merged.columns))


def aligned_check(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Whether two long tables cover the same keys: counts of keys on one side only."""
    left = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, keys, "full_outer")
    only_a = F.count(F.when(F.col("_b").isNull(), 1))
    only_b = F.count(F.when(F.col("_a").isNull(), 1))
    return both.groupBy().agg(
        only_a.alias("only_left"), only_b.alias("only_right"), ((only_a == 0) & (only_b == 0)).alias("aligned")
    )


def artefact(spark: SparkSession, path: str, build, mode: str = "warm") -> DataFrame:
    """Stored table: ``warm`` reads it when present; ``fresh`` always rebuilds."""
    if mode == "warm":
        try:
            return spark.read.parquet(path)
        except Exception as e:  # only a missing path leads to a rebuild
            if "PATH_NOT_FOUND" not in str(e):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def missing_cells(present: DataFrame, axes: dict[str, int] | list[DataFrame], keys: list[str]) -> DataFrame:
    """Cells of the index grid that have no row.

    ``axes`` is either {key: size} for 0-based indices, exploded from a range, or a
    list of one-column tables of any length: every cell is listed to be compared.
    """
    if isinstance(axes, dict):
        (first, n), *rest = axes.items()
        grid = present.sparkSession.range(n).withColumnRenamed("id", first)
        for k, m in rest:
            grid = grid.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    else:
        grid = axes[0]
        for a in axes[1:]:
            grid = grid.crossJoin(broadcast_checked(cut(a), 64))
    return grid.join(present.select(*keys), keys, "left_anti")
