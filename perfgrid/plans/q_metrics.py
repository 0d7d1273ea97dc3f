"""Registered queries: metrics, splits, ranking, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfgrid.functions import metrics as M
from perfgrid.functions.scalars import r6
from perfgrid.operators import ranking as R
from perfgrid.operators import select as S
from perfgrid.operators import splits as P
from perfgrid.plans import views as V
from perfgrid.plans.registry import query

CONFUSION_SQL = """tot AS (SELECT dataset_id, member, count(*) AS total FROM pred GROUP BY 1, 2),
lab AS (SELECT dataset_id, member, label AS class, count(*) AS pos,
               count(*) FILTER (WHERE prediction = label) AS tp FROM pred GROUP BY 1, 2, 3),
nam AS (SELECT dataset_id, member, prediction AS class, count(*) AS named FROM pred GROUP BY 1, 2, 3),
conf AS (SELECT lab.dataset_id, lab.member, lab.class, tp, total - pos - coalesce(named, 0) + tp AS tn,
                coalesce(named, 0) - tp AS fp, pos - tp AS fn
         FROM lab JOIN tot USING (dataset_id, member) LEFT JOIN nam USING (dataset_id, member, class))"""
PRED_CONF = V.ctes(V.CLS, V.PRED, CONFUSION_SQL)
BER_TERM = """1 - 0.5 * (tp / greatest(CAST(tp + fn AS DOUBLE), 1e-15)) - 0.5 * (tn / greatest(CAST(tn + fp AS DOUBLE), 1e-15))"""


@query("confusion", PRED_CONF + "SELECT dataset_id, member, class, tp, tn, fp, fn FROM conf")
def confusion(spark, d):
    return M.confusion(V.pred(spark, d), ["dataset_id", "member"])


@query("ber", PRED_CONF + f"SELECT dataset_id, member, round(avg({BER_TERM}), 6) AS ber FROM conf GROUP BY 1, 2")
def ber(spark, d):
    return M.ber(V.pred(spark, d), ["dataset_id", "member"]).withColumn("ber", r6("ber"))


@query(
    "class_error",
    PRED_CONF
    + "SELECT dataset_id, member, round(avg((fp + fn) / CAST(tp + tn + fp + fn AS DOUBLE)), 6) AS class_error FROM conf GROUP BY 1, 2",
)
def class_error(spark, d):
    return M.class_error(V.pred(spark, d), ["dataset_id", "member"]).withColumn("class_error", r6("class_error"))


@query(
    "mse",
    V.ctes(V.CLS)
    + "SELECT dataset_id, round(avg((l_quantity - l_extendedprice / 2000.0) * (l_quantity - l_extendedprice / 2000.0)), 6) AS mse FROM cls GROUP BY 1",
)
def mse(spark, d):
    rows = V.cls(spark, d).withColumn("p", F.col("l_extendedprice") / 2000.0)
    return M.mse(rows, ["dataset_id"], "l_quantity", "p").withColumn("mse", r6("mse"))


FOLD_ERR = """fc AS (SELECT p.dataset_id, p.member, f.fold, p.label, p.prediction FROM pred p JOIN folds f
   ON p.dataset_id = f.dataset_id AND p.row_id = f.row_id AND p.l_quantity = f.l_quantity AND p.l_extendedprice = f.l_extendedprice),
tot AS (SELECT dataset_id, member, fold, count(*) AS total FROM fc GROUP BY 1, 2, 3),
lab AS (SELECT dataset_id, member, fold, label AS class, count(*) AS pos, count(*) FILTER (WHERE prediction = label) AS tp FROM fc GROUP BY 1, 2, 3, 4),
nam AS (SELECT dataset_id, member, fold, prediction AS class, count(*) AS named FROM fc GROUP BY 1, 2, 3, 4),
conf AS (SELECT dataset_id, member, fold, class, tp, total - pos - coalesce(named, 0) + tp AS tn, coalesce(named, 0) - tp AS fp, pos - tp AS fn
  FROM lab JOIN tot USING (dataset_id, member, fold) LEFT JOIN nam USING (dataset_id, member, fold, class)),
fe AS (SELECT dataset_id, member, fold, avg(""" + BER_TERM + """) AS e FROM conf GROUP BY 1, 2, 3)
"""


@query(
    "cv_mean_error",
    V.ctes(V.CLS, V.FOLDS, V.PRED, FOLD_ERR)
    + "SELECT dataset_id, member, round(avg(e), 6) AS cv_error, count(*) AS n_folds FROM fe GROUP BY 1, 2",
)
def cv_mean_error(spark, d):
    m = F.col("member")
    rows = V.cls_folds(spark, d).withColumn("member", F.explode(F.array(*[F.lit(i) for i in V.MEMBERS])))
    rows = rows.withColumn(
        "prediction", F.when(F.col("l_quantity") > 8 * m, "A").when(F.col("l_discount") > F.lit(0.02) * m, "N").otherwise("R")
    )
    return S.mean_fold_error(M.ber(rows, ["dataset_id", "member", "fold"], out="error"), ["dataset_id", "member"])


@query(
    "best_on_average",
    V.ctes(V.PERF, V.HOLES)
    + "SELECT config_id, round(avg(error), 6) AS mean_error FROM holes GROUP BY 1 ORDER BY avg(error), config_id LIMIT 1",
)
def best_on_average(spark, d):
    return S.best_on_average(V.perf_holes(spark, d)).withColumn("mean_error", r6("mean_error"))


@query(
    "median_top",
    V.ctes(V.PERF_CONF)
    + """, med AS (SELECT config_id, median(error) AS med, avg(runtime) AS cost FROM perf_conf GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY med, config_id) AS r, count(*) OVER () AS m FROM med)
SELECT config_id, round(med, 6) AS median_error FROM rk WHERE r <= m // 10 AND cost <= 26.5""",
)
def median_top(spark, d):
    return S.median_top(V.perf_conf(spark, d), share=0.1, limit=26.5).withColumn("median_error", r6("median_error"))


@query(
    "label_mode",
    V.ctes(V.CLS)
    + """SELECT dataset_id, label AS common_label FROM (SELECT dataset_id, label,
 row_number() OVER (PARTITION BY dataset_id ORDER BY count(*) DESC, label) AS r FROM cls GROUP BY 1, 2) WHERE r = 1""",
)
def label_mode(spark, d):
    return R.grouped_mode(V.cls(spark, d), ["dataset_id"], "label", "common_label")


@query(
    "constant_folds",
    V.ctes(V.DOCS)
    + """, f AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, label ORDER BY md5(concat_ws('|', '7', doc_id)), doc_id) - 1) % 5 AS fold FROM docs),
g AS (SELECT concat_ws('-', lang, source) AS dataset_id, label, fold FROM f),
o AS (SELECT dataset_id, label, unnest(range(0, 5)) AS outer_fold, fold FROM g)
SELECT dataset_id, CAST(outer_fold AS INT) AS outer_fold, count(DISTINCT label) AS n_classes,
       CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS constant
FROM o WHERE fold <> outer_fold GROUP BY 1, 2""",
)
def constant_folds(spark, d):
    rows = V.docs(spark, d).withColumn("dataset_id", F.concat_ws("-", "lang", "source"))
    rows = rows.withColumn("rk", F.md5(F.concat_ws("|", F.lit("7"), F.col("doc_id").cast("string"))))
    folds = P.stratified_folds(rows, "dataset_id", "label", "rk", ["doc_id"])
    return P.constant_folds(folds, "dataset_id", "label").withColumnRenamed("outer", "outer_fold")


@query("stratified_folds", V.ctes(V.CLS, V.FOLDS) + "SELECT dataset_id, row_id, label, CAST(fold AS INT) AS fold FROM folds")
def stratified_folds(spark, d):
    return V.cls_folds(spark, d).select("dataset_id", "row_id", "label", "fold")


@query(
    "stratified_sample",
    V.ctes(V.CLS)
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, label ORDER BY rk, l_quantity, l_extendedprice) AS r,
  count(*) OVER (PARTITION BY dataset_id, label) AS nc, count(*) OVER (PARTITION BY dataset_id) AS n FROM cls)
SELECT dataset_id, row_id, label FROM r
WHERE CASE WHEN n > 1000 AND n / 5.0 > 100 THEN r <= round_even(CAST(500 AS DOUBLE) / n * nc, 0) ELSE TRUE END""",
)
def stratified_sample(spark, d):
    rows = P.stratified_sample(V.cls(spark, d), "dataset_id", "label", "rk", 5, V.TIES, min_rows=1000)
    return rows.select("dataset_id", "row_id", "label")


HOLDOUT_SQL = """q0 AS (SELECT {keys}, label, count(*) AS nc FROM {src} GROUP BY ALL),
q1 AS (SELECT *, sum(nc) OVER w AS n, CAST(ceil(sum(nc) OVER w * CAST(0.15 AS DOUBLE)) AS BIGINT) AS ntest, count(*) OVER w AS k, min(nc) OVER w AS mc
  FROM q0 WINDOW w AS (PARTITION BY {keys})),
q2 AS (SELECT *, n - ntest AS ntrain, (nc * (n - ntest)) // n AS fl, (nc * (n - ntest)) % n AS rest,
  mc >= 2 AND ntest >= k AND n - ntest >= k AS ok FROM q1),
q3 AS (SELECT *, fl + CASE WHEN row_number() OVER (PARTITION BY {keys} ORDER BY rest DESC, label) <= ntrain - sum(fl) OVER (PARTITION BY {keys}) THEN 1 ELSE 0 END AS quota FROM q2),
h AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY {skeys}, CASE WHEN ok THEN CAST(s.label AS VARCHAR) ELSE '*' END ORDER BY {order}) <= CASE WHEN ok THEN quota ELSE ntrain END
  THEN 'train' ELSE 'test' END AS part FROM {src} s JOIN q3 USING ({keys}, label))"""


@query(
    "holdout_split",
    V.ctes(V.CLS)
    + ", "
    + HOLDOUT_SQL.format(keys="dataset_id", skeys="dataset_id", src="cls", order="rk, l_quantity, l_extendedprice")
    + "SELECT dataset_id, row_id, label, part FROM h",
)
def holdout_split(spark, d):
    return P.holdout(V.cls(spark, d), ["dataset_id"], "label", "rk", V.TIES).select("dataset_id", "row_id", "label", "part")


@query(
    "nested_split",
    V.ctes(V.CLS, V.FOLDS)
    + """, ex AS (SELECT *, unnest(range(0, 5)) AS outer_fold FROM folds), tr AS (SELECT * FROM ex WHERE fold <> outer_fold), """
    + HOLDOUT_SQL.format(keys="dataset_id, outer_fold", skeys="dataset_id, outer_fold", src="tr", order="rk, l_quantity, l_extendedprice")
    + """, u AS (SELECT dataset_id, outer_fold, label, rk, CASE WHEN part = 'test' THEN 'valid' ELSE part END AS part FROM h
UNION ALL SELECT dataset_id, outer_fold, label, rk, 'test' FROM ex WHERE fold = outer_fold)
SELECT dataset_id, CAST(outer_fold AS INT) AS outer_fold, label, part, count(*) AS n,
  CAST(sum(CAST(('0x' || substr(rk, 1, 8)) AS BIGINT)) AS BIGINT) AS key_sum FROM u GROUP BY 1, 2, 3, 4""",
)
def nested_split(spark, d):
    rows = P.nested_split(V.cls(spark, d), "dataset_id", "label", "rk", V.TIES)
    return rows.groupBy("dataset_id", F.col("outer").alias("outer_fold"), "label", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring("rk", 1, 8), 16, 10).cast("bigint")).alias("key_sum")
    )


PREFIX_SQL = """c AS (SELECT dataset_id, config_id, runtime, sum(runtime) OVER (PARTITION BY dataset_id ORDER BY runtime, config_id ROWS UNBOUNDED PRECEDING) AS spent FROM perf_big)
SELECT dataset_id, config_id, round(spent, 6) AS spent FROM c WHERE spent <= """


@query("cheapest_prefix", V.ctes(V.PERF_BIG) + ", " + PREFIX_SQL + "600.0 / 4")
def cheapest_prefix(spark, d):
    t = S.cheapest_prefix(V.perf_big(spark, d), F.lit(600.0 / 4))
    return t.select("dataset_id", "config_id", r6("spent").alias("spent"))


@query(
    "greedy_prefix",
    V.ctes(V.PERF_BIG)
    + """, b AS (SELECT dataset_id, 5 * avg(runtime) AS budget FROM perf_big GROUP BY 1),
c AS (SELECT dataset_id, config_id, runtime, sum(runtime) OVER (PARTITION BY dataset_id ORDER BY runtime, config_id ROWS UNBOUNDED PRECEDING) AS spent FROM perf_big)
SELECT dataset_id, config_id, round(spent, 6) AS spent FROM c JOIN b USING (dataset_id) WHERE spent <= budget""",
)
def greedy_prefix(spark, d):
    p = V.perf_big(spark, d)
    budgets = p.groupBy("dataset_id").agg((F.lit(5) * F.avg("runtime")).alias("budget"))
    t = S.cheapest_prefix(p.join(budgets, "dataset_id"), F.col("budget"))
    return t.select("dataset_id", "config_id", r6("spent").alias("spent"))


@query(
    "rank_configs",
    V.ctes(V.PERF, V.STATUS)
    + """, r AS (SELECT dataset_id, config_id, error, row_number() OVER (PARTITION BY dataset_id ORDER BY error ASC NULLS LAST, config_id) AS place FROM stat)
SELECT dataset_id, config_id, place, round(error, 6) AS error FROM r WHERE place <= 5""",
)
def rank_configs(spark, d):
    t = S.rank_configs(V.with_status(V.perf(spark, d)), 5)
    return t.select("dataset_id", "config_id", "place", r6("error").alias("error"))


@query(
    "topk_per_group",
    V.ctes(V.PERF_BIG)
    + """SELECT dataset_id, config_id, place FROM (SELECT dataset_id, config_id,
 row_number() OVER (PARTITION BY dataset_id ORDER BY runtime, config_id) AS place FROM perf_big) WHERE place <= 3""",
)
def topk_per_group(spark, d):
    order = [F.col("runtime"), F.col("config_id")]
    return R.top_k(V.perf_big(spark, d), ["dataset_id"], order, 3, "place").select("dataset_id", "config_id", "place")


SETS = V.ctes(V.PERF) + """, a AS (SELECT dataset_id, config_id FROM perf WHERE runtime <= 26.0),
g AS (SELECT dataset_id, config_id FROM perf WHERE error <= 0.3) """


def _two_sets(spark, d):
    p = V.perf(spark, d)
    return S.affordable(p, F.lit(26.0)).select("dataset_id", "config_id"), p.filter("error <= 0.3").select("dataset_id", "config_id")


@query("measured_union", SETS + "SELECT * FROM a UNION SELECT * FROM g")
def measured_union(spark, d):
    a, g = _two_sets(spark, d)
    return a.union(g).distinct()


@query("measured_except", SETS + "SELECT * FROM a EXCEPT SELECT * FROM g")
def measured_except(spark, d):
    a, g = _two_sets(spark, d)
    return a.join(g, ["dataset_id", "config_id"], "left_anti")


@query("measured_intersect", SETS + "SELECT * FROM a INTERSECT SELECT * FROM g")
def measured_intersect(spark, d):
    a, g = _two_sets(spark, d)
    return a.join(g, ["dataset_id", "config_id"], "left_semi")
