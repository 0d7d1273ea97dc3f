"""Stand-in inputs over the given tables, once for Spark and once as SQL text.

Missing values come from the data itself: an unrecorded (zero) tax, a status that
is unknown at the highest discount, and measurements that overran their time limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfgrid.functions.scalars import hash_order

SEED = 7
TIMEOUT = 26.5
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TIES = ["l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cls(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows of many datasets: four numeric and one categorical feature."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dataset_id"))
    li = table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return (
        li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("row_id", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
        .withColumn("rk", hash_order(SEED, *keys))
        .select("dataset_id", "row_id", "rk", *FEATURES, "l_linestatus", F.col("l_returnflag").alias("label"))
    )


CLS = f"""cls AS (
  SELECT s_nationkey AS dataset_id, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
         md5(concat_ws('|', '{SEED}', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS rk,
         l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_returnflag AS label
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

FOLDS = """folds AS (
  SELECT *, (row_number() OVER (PARTITION BY dataset_id, label ORDER BY rk, l_quantity, l_extendedprice) - 1) % 5 AS fold
  FROM cls)"""


def cls_folds(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    from perfgrid.operators.splits import stratified_folds

    return stratified_folds(cls(spark, d), "dataset_id", "label", "rk", TIES, k)


def miss(spark: SparkSession, d: str) -> DataFrame:
    return (
        cls(spark, d)
        .withColumn("l_tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))
        .withColumn("l_linestatus", F.when(F.col("l_discount") < 0.095, F.col("l_linestatus")))
        .withColumn("x_empty", F.lit(None).cast("double"))
    )


MISS = """miss AS (
  SELECT dataset_id, row_id, rk, l_quantity, l_extendedprice, l_discount,
         CASE WHEN l_tax > 0 THEN l_tax END AS l_tax,
         CASE WHEN l_discount < 0.095 THEN l_linestatus END AS l_linestatus, label,
         CAST(NULL AS DOUBLE) AS x_empty
  FROM cls)"""


def _perf(spark: SparkSession, d: str, keys: list) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    p = table(spark, d, "part").select(
        "p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int").alias("brand"), "p_type", "p_size"
    )
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_tax")
    rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(*keys).agg(
        F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("error"),
        (F.lit(0.5) + F.avg("l_quantity") + F.lit(10) * F.avg("l_tax")).alias("runtime"),
    )


def perf(spark: SparkSession, d: str) -> DataFrame:
    return _perf(spark, d, [F.col("s_nationkey").alias("dataset_id"), F.col("brand").alias("config_id")])


def perf_big(spark: SparkSession, d: str) -> DataFrame:
    return _perf(spark, d, [F.col("l_suppkey").alias("dataset_id"), F.col("brand").alias("config_id")])


def perf_conf(spark: SparkSession, d: str) -> DataFrame:
    """Performance rows whose config is an algorithm with one hyperparameter."""
    t = _perf(spark, d, [F.col("s_nationkey").alias("dataset_id"), "p_type", "p_size"])
    size = F.col("p_size").cast("string")
    return t.select(
        "dataset_id",
        F.concat_ws("-", F.col("p_type"), size).alias("config_id"),
        F.col("p_type").alias("algorithm"),
        F.create_map(F.lit("size"), size).alias("hyperparameters"),
        "error",
        "runtime",
    )


def _perf_sql(name: str, keys: str, n: int = 2) -> str:
    group = ", ".join(str(i + 1) for i in range(n))
    return f"""{name} AS (
  SELECT {keys}, avg(CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS error,
         0.5 + avg(l_quantity) + 10 * avg(l_tax) AS runtime
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY {group})"""


BRAND = "CAST(split_part(p_brand, '#', 2) AS INT) AS config_id"
PERF = _perf_sql("perf", f"s_nationkey AS dataset_id, {BRAND}")
PERF_BIG = _perf_sql("perf_big", f"l_suppkey AS dataset_id, {BRAND}")
PERF_CONF = _perf_sql(
    "perf_conf",
    "s_nationkey AS dataset_id, concat_ws('-', p_type, p_size) AS config_id, p_type AS algorithm, p_size AS size",
    4,
)


def with_status(p: DataFrame) -> DataFrame:
    """Runs over the limit have no error: status instead of a sentinel number."""
    late = F.col("runtime") > TIMEOUT
    return p.withColumn("status", F.when(late, "timeout").otherwise("ok")).withColumn("error", F.when(~late, F.col("error")))


def perf_holes(spark: SparkSession, d: str) -> DataFrame:
    return perf(spark, d).filter(F.col("runtime") <= TIMEOUT)


HOLES = f"holes AS (SELECT * FROM perf WHERE runtime <= {TIMEOUT})"
STATUS = f"""stat AS (SELECT dataset_id, config_id, CASE WHEN runtime > {TIMEOUT} THEN NULL ELSE error END AS error, runtime,
  CASE WHEN runtime > {TIMEOUT} THEN 'timeout' ELSE 'ok' END AS status FROM perf)"""


def tensor(spark: SparkSession, d: str) -> DataFrame:
    """Five-mode table nation x brand x type x flag x status, indices 0-based, with natural holes."""
    types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("i0"))
    p = table(spark, d, "part").select(
        "p_partkey",
        (F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int") - 1).alias("i1"),
        (F.array_position(F.array(*[F.lit(t) for t in types]), F.col("p_type")) - 1).cast("int").alias("i2"),
    )
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount")
    rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    flag = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")) - 1
    status = F.array_position(F.array(F.lit("F"), F.lit("O")), F.col("l_linestatus")) - 1
    return rows.groupBy("i0", "i1", "i2", flag.cast("int").alias("i3"), status.cast("int").alias("i4")).agg(
        F.avg("l_discount").alias("value")
    )


TENSOR_SIZES = [25, 25, 6, 3, 2]
TENSOR = """tensor AS (
  SELECT s_nationkey AS i0, CAST(split_part(p_brand, '#', 2) AS INT) - 1 AS i1,
         CAST(list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type) AS INT) - 1 AS i2,
         CAST(list_position(['A','N','R'], l_returnflag) AS INT) - 1 AS i3,
         CAST(list_position(['F','O'], l_linestatus) AS INT) - 1 AS i4, avg(l_discount) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4, 5)"""


def sizes(spark: SparkSession, d: str) -> DataFrame:
    from perfgrid.sources.tables import dataset_sizes

    return dataset_sizes(cls(spark, d), "dataset_id", len(FEATURES) + 1)


SIZES = """sizes AS (SELECT s_nationkey AS dataset_id, count(*) AS n_rows, CAST(5 AS BIGINT) AS n_features
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"""

MEMBERS = [1, 2, 3, 4, 5]


def pred(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions of five rule-based members on every row."""
    m = F.col("member")
    rule = F.when(F.col("l_quantity") > 8 * m, "A").when(F.col("l_discount") > F.lit(0.02) * m, "N").otherwise("R")
    return (
        cls(spark, d)
        .withColumn("member", F.explode(F.array(*[F.lit(i) for i in MEMBERS])))
        .withColumn("prediction", rule)
        .select("dataset_id", "row_id", "member", "label", "prediction", "rk", *TIES)
    )


PRED = """pred AS (
  SELECT dataset_id, row_id, CAST(m AS INT) AS member, label, rk, l_quantity, l_extendedprice,
         CASE WHEN l_quantity > 8 * m THEN 'A' WHEN l_discount > CAST(0.02 AS DOUBLE) * m THEN 'N' ELSE 'R' END AS prediction
  FROM cls, (SELECT unnest([1, 2, 3, 4, 5]) AS m))"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Mixed-type labelled rows: one number, two categories, an unbalanced label."""
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source").join(lab, "doc_id")


DOCS = "docs AS (SELECT d.doc_id, n_chars, lang, source, quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), "label"
    )


EMB = "emb AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
EMB_LONG = "embl AS (SELECT row_id, label, unnest(x) AS v, unnest(range(0, 64)) AS j FROM emb)"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
