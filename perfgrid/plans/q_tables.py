"""Registered queries: sources, grids, performance tables, filters, joins, scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfgrid.functions import scalars as C
from perfgrid.functions.scalars import r6
from perfgrid.operators import select as S
from perfgrid.plans import views as V
from perfgrid.plans.registry import query
from perfgrid.session import cut, listing_in_few_tasks, partitions, shared_dir
from perfgrid.sources import grids as G
from perfgrid.sources import tables as X
from perfgrid.streaming.merge import merged_table, stream_merge


def scratch(spark, name: str) -> str:
    """New folder below the shared one; every run has its own."""
    return f"{shared_dir(spark).rstrip('/')}/perfgrid-{name}-{uuid.uuid4().hex}"


@query(
    "load_labelled",
    V.ctes(V.CLS)
    + """SELECT CAST(dataset_id AS BIGINT) AS dataset_id, label, count(*) AS n, round(sum(l_quantity), 6) AS sum_quantity,
 round(avg(l_tax), 6) AS avg_tax, count(CASE WHEN l_discount > 0 THEN 1 END) AS n_discount FROM cls GROUP BY 1, 2""",
)
def load_labelled(spark, d):
    """Writes one headerless CSV folder per dataset, NaN for missing, and loads them all."""
    out = scratch(spark, "labelled")
    rows = V.cls(spark, d).select(
        "dataset_id", "l_quantity", "l_tax", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"), "label"
    )
    name = F.concat(F.lit("set"), C.padded_id("dataset_id"))
    rows.withColumn("set", name).drop("dataset_id").repartition(F.col("set")).write.partitionBy("set").csv(out, nullValue="nan")
    schema = T.StructType.fromDDL("l_quantity double, l_tax double, l_discount double, label string")
    raw = X.nan_to_null(spark.read.csv(out + "/set=*", schema=schema, header=False, nanValue="nan").withColumn("_p", F.col("_metadata.file_path")))
    t = raw.withColumn("dataset_id", C.first_integer(F.regexp_extract("_p", r"set=([^/]*)", 1)))
    return t.groupBy("dataset_id", "label").agg(
        F.count(F.lit(1)).alias("n"),
        r6(F.sum("l_quantity")).alias("sum_quantity"),
        r6(F.avg("l_tax")).alias("avg_tax"),
        F.count("l_discount").alias("n_discount"),
    )


BRANDS = list(range(1, 26))


@query(
    "perf_pivot",
    V.ctes(V.PERF, V.HOLES)
    + "SELECT dataset_id, "
    + ", ".join(f'round(max(CASE WHEN config_id = {b} THEN error END), 6) AS "{b}"' for b in BRANDS)
    + " FROM holes GROUP BY 1",
)
def perf_pivot(spark, d):
    wide = X.perf_pivot(V.perf_holes(spark, d), "dataset_id", "config_id", "error", BRANDS)
    return wide.select("dataset_id", *[r6(f"`{b}`").alias(str(b)) for b in BRANDS])


@query(
    "perf_unpivot",
    V.ctes(V.PERF, V.HOLES) + "SELECT dataset_id, CAST(config_id AS VARCHAR) AS config, round(error, 6) AS error FROM holes",
)
def perf_unpivot(spark, d):
    wide = X.perf_pivot(V.perf_holes(spark, d), "dataset_id", "config_id", "error", BRANDS)
    return X.perf_unpivot(wide, "dataset_id").withColumn("error", r6("error"))


@query("dataset_sizes", V.ctes(V.SIZES) + "SELECT dataset_id, n_rows, n_features FROM sizes")
def dataset_sizes(spark, d):
    rows = V.cls(spark, d)
    asia = V.table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("dataset_id"))
    known = X.dataset_sizes(rows.join(asia, "dataset_id", "left_semi"), "dataset_id", 5)
    return X.dataset_sizes(rows, "dataset_id", 5, known)


@query(
    "tensor_coo",
    V.ctes(V.TENSOR)
    + "SELECT i0, CAST(((i1 * 6 + i2) * 3 + i3) * 2 + i4 AS BIGINT) AS config_id, round(value, 6) AS value FROM tensor",
)
def tensor_coo(spark, d):
    t = V.tensor(spark, d)
    idx = G.linear_index([F.col(f"i{m}") for m in (1, 2, 3, 4)], V.TENSOR_SIZES[1:])
    return t.select("i0", idx.alias("config_id"), r6("value").alias("value"))


def _result_texts(spark, d):
    """Result files of every dataset as text: headings in two orders, timed-out cells empty."""
    p = V.with_status(V.perf_big(spark, d))
    cell = F.struct(
        F.when(F.col("dataset_id") > F.lit(20), F.col("config_id")).otherwise(-F.col("config_id")).alias("o"),
        F.concat(F.lit('"{""c"": '), F.col("config_id").cast("string"), F.lit(', ""a"": 1}"')).alias("h"),
        F.coalesce(F.when(F.col("runtime") > 32.0, None).otherwise(F.coalesce("error", F.lit(1.0))).cast("string"), F.lit("")).alias("e"),
        F.col("runtime").cast("string").alias("t"),
    )
    files = p.groupBy("dataset_id").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    line = lambda head, f: F.concat(F.lit(head + ","), F.array_join(F.col("c")[f], ","))
    return files.select(
        C.padded_id("dataset_id").alias("name"), F.concat_ws("\n", line("", "h"), line("Error", "e"), line("Time", "t")).alias("value")
    )


MERGE_SQL = (
    V.ctes(V.PERF_BIG, V.STATUS.replace("perf)", "perf_big)"))
    + """, cells AS (SELECT dataset_id, config_id, CASE WHEN runtime > 32.0 THEN NULL ELSE coalesce(error, 1.0) END AS error, runtime FROM stat),
ok AS (SELECT dataset_id FROM cells GROUP BY 1 HAVING count(error) = (SELECT count(DISTINCT config_id) FROM cells))
SELECT lpad(CAST(dataset_id AS VARCHAR), 5, '0') AS dataset_id, concat('{"c": ', config_id, ', "a": 1}') AS config,
  round(error, 6) AS error, round(runtime, 6) AS runtime FROM cells SEMI JOIN ok USING (dataset_id)"""
)


def _write_results(texts, out: str) -> None:
    """One file per dataset, named after it. Files cost far more than their bytes, so the number of tasks is given."""
    texts.repartition(4 * partitions(texts.sparkSession), "name").write.partitionBy("name").text(out)


def _merged(t):
    return t.select("dataset_id", "config", r6("error").alias("error"), r6("runtime").alias("runtime"))


@query("merge_rows", MERGE_SQL)
def merge_rows(spark, d):
    """The first merge takes the ids below 50, the second finds everything again."""
    texts = _result_texts(spark, d).select(F.concat(F.lit("/"), "name", F.lit(".csv")).alias("path"), F.col("value").alias("content"))
    cells = cut(X.parse_results(texts))
    early = cells.filter(F.col("dataset_id") < "00050")
    empty = spark.createDataFrame([], X.RESULT)
    return _merged(X.merge_rows(cut(X.merge_rows(empty, early)), cells))


@query("stream_merge", MERGE_SQL)
def stream_merge_query(spark, d):
    src, out, ck = scratch(spark, "arrivals"), scratch(spark, "merged"), scratch(spark, "stream")
    _result_texts(spark, d).select(F.concat("name", F.lit(".csv")).alias("name"), "value").transform(lambda t: _write_results(t, src) or t)
    with listing_in_few_tasks(spark):
        stream_merge(spark, src, out, ck).awaitTermination()
        return _merged(merged_table(spark, out))


@query(
    "filter_configs",
    V.ctes(V.PERF_CONF)
    + """SELECT dataset_id, config_id, round(error, 6) AS error FROM perf_conf
WHERE algorithm IN ('SMALL', 'LARGE') AND (algorithm <> 'SMALL' OR size IN (1, 5, 9, 17))""",
)
def filter_configs(spark, d):
    t = S.filter_configs(V.perf_conf(spark, d), ["SMALL", "LARGE"], {"SMALL": {"size": ["1", "5", "9", "17"]}})
    return t.select("dataset_id", "config_id", r6("error").alias("error"))


@query(
    "filter_config_ids",
    V.ctes(V.PERF_CONF)
    + "SELECT DISTINCT config_id FROM perf_conf WHERE algorithm IN ('SMALL', 'LARGE') AND (algorithm <> 'SMALL' OR size IN (1, 5, 9, 17))",
)
def filter_config_ids(spark, d):
    t = S.filter_configs(V.perf_conf(spark, d), ["SMALL", "LARGE"], {"SMALL": {"size": ["1", "5", "9", "17"]}})
    return t.select("config_id").distinct()


@query(
    "affordable",
    V.ctes(V.PERF)
    + """, b AS (SELECT dataset_id, median(runtime) * 2 AS lim FROM perf GROUP BY 1)
SELECT dataset_id, config_id, round(runtime, 6) AS runtime FROM perf JOIN b USING (dataset_id) WHERE runtime <= 0.5 * lim""",
)
def affordable(spark, d):
    from perfgrid.operators.ranking import grouped_quantile

    p = V.perf(spark, d)
    limits = grouped_quantile(p, ["dataset_id"], "runtime", 0.5, "med").withColumn("lim", F.col("med") * 2)
    t = S.affordable(p.join(limits, "dataset_id"), F.lit(0.5) * F.col("lim"))
    return t.select("dataset_id", "config_id", r6("runtime").alias("runtime"))


@query("observed_cells", V.ctes(V.PERF, V.STATUS) + "SELECT dataset_id, config_id, round(error, 6) AS error FROM stat WHERE error IS NOT NULL")
def observed_cells(spark, d):
    nan = V.with_status(V.perf(spark, d)).withColumn("error", F.coalesce("error", F.lit(float("nan"))))
    return X.nan_to_null(nan).dropna(subset=["error"]).select("dataset_id", "config_id", r6("error").alias("error"))


@query(
    "missing_cells",
    V.ctes(V.TENSOR)
    + """SELECT a.i0, b.i1, c.i2, e.i3, f.i4 FROM (SELECT CAST(unnest(range(25)) AS INT) AS i0) a, (SELECT CAST(unnest(range(25)) AS INT) AS i1) b,
(SELECT CAST(unnest(range(6)) AS INT) AS i2) c, (SELECT CAST(unnest(range(3)) AS INT) AS i3) e, (SELECT CAST(unnest(range(2)) AS INT) AS i4) f
ANTI JOIN tensor t ON a.i0 = t.i0 AND b.i1 = t.i1 AND c.i2 = t.i2 AND e.i3 = t.i3 AND f.i4 = t.i4""",
)
def missing_cells(spark, d):
    axes = {f"i{m}": n for m, n in enumerate(V.TENSOR_SIZES)}
    out = X.missing_cells(V.tensor(spark, d), axes, list(axes))
    return out.select(*[F.col(k).cast("int").alias(k) for k in axes])


@query(
    "valid_errors",
    V.ctes(V.PERF, V.STATUS) + "SELECT dataset_id, config_id, status, round(error, 6) AS error FROM stat",
)
def valid_errors(spark, d):
    """Errors of overrunning runs are recorded, then voided by their status."""
    status = F.when(F.col("runtime") > V.TIMEOUT, "timeout").otherwise("ok")
    t = S.valid_errors(V.perf(spark, d).withColumn("status", status))
    return t.select("dataset_id", "config_id", "status", r6("error").alias("error"))


@query(
    "complete_datasets",
    V.ctes(V.PERF_BIG)
    + """, c AS (SELECT dataset_id, config_id, CASE WHEN runtime <= 32 THEN error END AS error FROM perf_big),
ok AS (SELECT dataset_id FROM c GROUP BY 1 HAVING count(error) = 25)
SELECT dataset_id, config_id, round(error, 6) AS error FROM c SEMI JOIN ok USING (dataset_id)""",
)
def complete_datasets(spark, d):
    p = V.perf_big(spark, d).withColumn("error", F.when(F.col("runtime") <= 32, F.col("error")))
    t = X.complete_datasets(p, "dataset_id", 25, ["error"])
    return t.select("dataset_id", "config_id", r6("error").alias("error"))


@query(
    "resolve_pct",
    V.ctes(V.SIZES)
    + """, r AS (SELECT * FROM (VALUES (0, NULL, NULL), (1, 'PCA', 0.25), (2, 'PCA', 0.5), (3, 'PCA', 0.75), (4, 'VarianceThreshold', NULL),
 (5, 'SelectKBest', 0.25), (6, 'SelectKBest', 0.5), (7, 'SelectKBest', 0.75)) AS t(reducer_id, algorithm, share))
SELECT dataset_id, CAST(reducer_id AS BIGINT) AS reducer_id, algorithm,
  CAST(CASE WHEN algorithm = 'PCA' THEN floor(least(4 * n_rows / 5.0, share * n_features * 8))
            WHEN algorithm = 'SelectKBest' THEN floor(share * n_features * 8) END AS BIGINT) AS resolved FROM sizes, r""",
)
def resolve_pct(spark, d):
    wide = V.sizes(spark, d).withColumn("n_features", F.col("n_features") * 8)
    tasks = G.task_grid(wide, G.STEPS["dim_reducer"])
    tasks = tasks.withColumn("dim_reducer", F.struct("algorithm", "hyperparameters"))
    return G.resolve_shares(tasks).select("dataset_id", F.col("config_id").alias("reducer_id"), "algorithm", "resolved")


@query(
    "initial_budget",
    V.ctes(V.PERF)
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY runtime, config_id) AS k FROM perf)
SELECT dataset_id, round(greatest(pow(2, floor(log2(512 / 8.0))), pow(2, floor(log2(sum(greatest(runtime, 0.5)))))), 6) AS tall_budget,
  round(greatest(1.0, pow(2, floor(log2(sum(greatest(runtime, 0.5)))))), 6) AS budget FROM r WHERE k <= 10 GROUP BY 1""",
)
def initial_budget(spark, d):
    from perfgrid.operators.cost import initial_budget as first

    p = V.perf(spark, d)
    small = first(p, 10, floor_limit=None).withColumnRenamed("initial_budget", "budget")
    tall = first(p, 10, floor_limit=512).withColumnRenamed("initial_budget", "tall_budget")
    return small.join(tall, "dataset_id").select("dataset_id", r6("tall_budget").alias("tall_budget"), r6("budget").alias("budget"))


def _grid_sql() -> str:
    """SQL text of the estimator grid: one SELECT per algorithm, lists unnested with ordinals."""
    parts, start = [], 0
    for algorithm, lists in G.ESTIMATORS.items():
        total = 1
        for v in lists.values():
            total *= len(v)
        src, pos, text, below = [], "0", [], total
        for i, (name, values) in enumerate(lists.items()):
            below //= len(values)
            items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
            src.append(f"(SELECT unnest([{items}]) AS v{i}, unnest(range({len(values)})) AS p{i})")
            pos += f" + p{i} * {below}"
            text.append(f"'{name}=' || coalesce(v{i}, '-')")
        body = " || ';' || ".join(text) if text else "''"
        parts.append(f"SELECT {start} + {pos} AS config_id, '{algorithm}' AS algorithm, {body} AS params" + (f" FROM {', '.join(src)}" if src else ""))
        start += total
    return " UNION ALL ".join(parts)


@query(
    "task_grid",
    V.ctes(V.SIZES)
    + f""", g AS ({_grid_sql()}), f AS (SELECT CAST(unnest(range(5)) AS INT) AS fold)
SELECT dataset_id, CAST(config_id AS BIGINT) AS config_id, algorithm, params, fold FROM sizes, g, f""",
)
def task_grid(spark, d):
    data = V.sizes(spark, d).select("dataset_id")
    t = G.task_grid(data, k=5)
    pair = F.transform(F.map_entries("hyperparameters"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))
    return t.select("dataset_id", "config_id", "algorithm", F.array_join(pair, ";").alias("params"), "fold")


@query(
    "search_space",
    V.ctes(V.SIZES)
    + """, c AS (SELECT dataset_id, unnest(range(23424)) AS id FROM sizes), s AS (SELECT dataset_id, id, (id // 183) % 8 AS dim, (id // 1464) % 2 AS std,
 (id // 2928) % 2 AS enc, id // 5856 AS imp FROM c)
SELECT dataset_id, ['mean','median','most_frequent','constant'][imp + 1] AS strategy, enc = 1 AS encoded, std = 1 AS standardized,
 CASE WHEN dim = 0 THEN 'none' WHEN dim <= 3 THEN 'PCA' WHEN dim = 4 THEN 'VarianceThreshold' ELSE 'SelectKBest' END AS reducer,
 count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM s GROUP BY ALL""",
)
def search_space(spark, d):
    t = G.search_space(V.sizes(spark, d).select("dataset_id"))
    return t.groupBy(
        "dataset_id",
        F.col("imputer.hyperparameters")["strategy"].alias("strategy"),
        F.col("encoder.algorithm").isNotNull().alias("encoded"),
        F.col("standardizer.algorithm").isNotNull().alias("standardized"),
        F.coalesce(F.col("dim_reducer.algorithm"), F.lit("none")).alias("reducer"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("config_id").alias("id_sum"))


@query("config_json_roundtrip", V.ctes(V.SIZES) + "SELECT dataset_id, CAST(183 AS BIGINT) AS n_equal, CAST(183 AS BIGINT) AS n_headings FROM sizes")
def config_json_roundtrip(spark, d):
    t = G.task_grid(V.sizes(spark, d).select("dataset_id"))
    t = t.withColumn("heading", G.config_json(F.col("algorithm"), F.col("hyperparameters"))).withColumn("back", G.parse_config(F.col("heading")))
    same = (F.col("back.algorithm") == F.col("algorithm")) & (
        F.array_sort(F.map_entries("back.hyperparameters")) == F.array_sort(F.map_entries("hyperparameters"))
    )
    return t.groupBy("dataset_id").agg(F.count(F.when(same, 1)).alias("n_equal"), F.count_distinct("heading").alias("n_headings"))


@query(
    "sizes_join",
    V.ctes(V.PERF, V.SIZES)
    + "SELECT dataset_id, config_id, n_rows, n_features, round(ln(runtime), 6) AS log_runtime FROM perf JOIN sizes USING (dataset_id)",
)
def sizes_join(spark, d):
    t = V.perf(spark, d).join(V.sizes(spark, d), "dataset_id")
    return t.select("dataset_id", "config_id", "n_rows", "n_features", r6(F.log("runtime")).alias("log_runtime"))


@query(
    "todo_tasks",
    V.ctes(V.PERF, V.HOLES, V.SIZES)
    + "SELECT dataset_id, CAST(c AS INT) AS config_id FROM sizes, (SELECT unnest(range(1, 26)) AS c) ANTI JOIN holes ON sizes.dataset_id = holes.dataset_id AND c = config_id",
)
def todo_tasks(spark, d):
    tasks = V.sizes(spark, d).select("dataset_id", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("config_id"))
    return tasks.join(V.perf_holes(spark, d), ["dataset_id", "config_id"], "left_anti")


@query(
    "reuse_measured",
    V.ctes(V.PERF, V.HOLES)
    + """, c AS (SELECT dataset_id, config_id, row_number() OVER (PARTITION BY dataset_id ORDER BY runtime DESC, config_id) AS r FROM perf)
SELECT dataset_id, config_id, round(error, 6) AS error FROM holes SEMI JOIN c ON c.dataset_id = holes.dataset_id AND c.config_id = holes.config_id AND r <= 15""",
)
def reuse_measured(spark, d):
    from perfgrid.operators.ranking import top_k

    candidates = top_k(V.perf(spark, d), ["dataset_id"], [F.col("runtime").desc(), F.col("config_id")], 15)
    done = V.perf_holes(spark, d).join(candidates, ["dataset_id", "config_id"], "left_semi")
    return done.select("dataset_id", "config_id", r6("error").alias("error"))


@query("features_labels", "SELECT d.doc_id, n_chars, lang, source, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def features_labels(spark, d):
    x = V.table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    return x.join(V.table(spark, d, "labels"), "doc_id")


@query(
    "aligned_check",
    V.ctes(V.PERF, V.HOLES)
    + """SELECT (SELECT count(*) FROM perf) - (SELECT count(*) FROM holes) AS only_left, CAST(0 AS BIGINT) AS only_right,
 (SELECT count(*) FROM perf) = (SELECT count(*) FROM holes) AS aligned""",
)
def aligned_check(spark, d):
    return X.aligned_check(V.perf(spark, d), V.perf_holes(spark, d), ["dataset_id", "config_id"])


@query(
    "dataset_id_fns",
    """SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '(\\d+)', 1), '') AS BIGINT) AS first_int, split_part(url, '.', 1) AS stem,
 CASE WHEN length(CAST(page_id AS VARCHAR)) >= 5 THEN CAST(page_id AS VARCHAR) ELSE lpad(CAST(page_id AS VARCHAR), 5, '0') END AS padded FROM pages""",
)
def dataset_id_fns(spark, d):
    return V.table(spark, d, "pages").select(
        "page_id", C.first_integer("url").alias("first_int"), C.stem("url").alias("stem"), C.padded_id("page_id").alias("padded")
    )


@query(
    "int_coerce",
    """SELECT event_id, CASE WHEN abs(v - round(v)) <= 1e-9 * greatest(abs(v), abs(round(v))) THEN 'int' ELSE 'float' END AS kind,
 CASE WHEN abs(v - round(v)) <= 1e-9 * greatest(abs(v), abs(round(v))) THEN CAST(CAST(round(v) AS BIGINT) AS VARCHAR) END AS int_text
 FROM (SELECT event_id, round(value, 1) AS v FROM events)""",
)
def int_coerce(spark, d):
    t = V.table(spark, d, "events").select("event_id", C.int_text(F.round("value", 1)).alias("t"))
    is_int = ~F.col("t").contains(".")
    return t.select("event_id", F.when(is_int, "int").otherwise("float").alias("kind"), F.when(is_int, F.col("t")).alias("int_text"))


POLY = [
    "1.0", "n", "d", "l", "n*n", "n*d", "n*l", "d*d", "d*l", "l*l", "n*n*n", "n*n*d", "n*n*l", "n*d*d", "n*d*l", "n*l*l",
    "d*d*d", "d*d*l", "d*l*l", "l*l*l",
]


@query(
    "poly_features",
    V.ctes(V.SIZES)
    + ", s AS (SELECT dataset_id, CAST(n_rows AS DOUBLE) AS n, CAST(n_features AS DOUBLE) AS d, ln(n_rows) AS l FROM sizes) SELECT dataset_id, "
    + ", ".join(f"round(CAST({t} AS DOUBLE) / 1000, 4) AS t{i}" for i, t in enumerate(POLY))
    + " FROM s",
)
def poly_features(spark, d):
    terms = C.size_terms("n_rows", "n_features")
    return V.sizes(spark, d).select("dataset_id", *[F.round(t / 1000, 4).alias(f"t{i}") for i, t in enumerate(terms)])


@query(
    "minkowski",
    V.ctes(V.EMB, V.EMB_LONG)
    + """, c AS (SELECT label, j, avg(v) AS m FROM embl GROUP BY 1, 2)
SELECT row_id, round(sum(abs(v - m)), 6) AS d1, round(sqrt(sum((v - m) * (v - m))), 6) AS d2 FROM embl JOIN c USING (label, j) GROUP BY 1""",
)
def minkowski(spark, d):
    """Distance of every vector from the mean of its class."""
    e = V.emb(spark, d)
    centre = e.groupBy("label").agg(F.array(*[F.avg(F.col("x")[j]) for j in range(64)]).alias("m"))
    t = e.join(centre, "label")
    return t.select("row_id", r6(C.minkowski("x", "m", 1)).alias("d1"), r6(C.minkowski("x", "m", 2)).alias("d2"))
