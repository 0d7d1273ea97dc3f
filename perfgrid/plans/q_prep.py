"""Registered queries: feature preparation and naive Bayes."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfgrid.functions import metrics as M
from perfgrid.functions.scalars import r6
from perfgrid.operators import gnb
from perfgrid.operators import prep as P
from perfgrid.operators.select import mean_fold_error
from perfgrid.plans import views as V
from perfgrid.plans.registry import query
from perfgrid.session import cut

ROW = ["dataset_id", "row_id"]
FILL = {
    "mean": "avg(l_tax)",
    "median": "median(l_tax)",
    "mode": "(SELECT NULL)",
    "const": "CAST(0 AS DOUBLE)",
}


def _impute_sql(agg: str) -> str:
    fill = f"f AS (SELECT dataset_id, {agg} AS fill FROM miss GROUP BY 1)"
    if agg == FILL["mode"]:
        fill = """f AS (SELECT dataset_id, l_tax AS fill FROM (SELECT dataset_id, l_tax,
 row_number() OVER (PARTITION BY dataset_id ORDER BY count(*) DESC, l_tax) AS r FROM miss WHERE l_tax IS NOT NULL GROUP BY 1, 2) WHERE r = 1)"""
    return V.ctes(V.CLS, V.MISS, fill) + "SELECT dataset_id, row_id, round(coalesce(l_tax, fill), 6) AS l_tax FROM miss JOIN f USING (dataset_id)"


def _impute(strategy):
    def run(spark, d):
        t = P.impute(V.miss(spark, d), ["dataset_id"], ["l_tax"], strategy)
        return t.select(*ROW, r6("l_tax").alias("l_tax"))

    return run


for _name, _strategy in {"mean": "mean", "median": "median", "mode": "most_frequent", "const": "constant"}.items():
    query(f"impute_{_name}", _impute_sql(FILL[_name]))(_impute(_strategy))

MIXED = """cm AS (SELECT dataset_id, l_linestatus AS cmode FROM (SELECT dataset_id, l_linestatus,
 row_number() OVER (PARTITION BY dataset_id ORDER BY count(*) DESC, l_linestatus) AS r FROM miss WHERE l_linestatus IS NOT NULL GROUP BY 1, 2) WHERE r = 1),
nm AS (SELECT dataset_id, avg(l_tax) AS tmean FROM miss GROUP BY 1),
mixed AS (SELECT dataset_id, row_id, coalesce(l_linestatus, cmode) AS l_linestatus, l_quantity, l_extendedprice, l_discount, coalesce(l_tax, tmean) AS l_tax
 FROM miss JOIN cm USING (dataset_id) JOIN nm USING (dataset_id))"""
NUM = V.FEATURES


@query(
    "preprocess_mixed",
    V.ctes(V.CLS, V.MISS, MIXED) + "SELECT dataset_id, row_id, l_linestatus, l_quantity, round(l_tax, 6) AS l_tax FROM mixed",
)
def preprocess_mixed(spark, d):
    t = P.impute_mixed(V.miss(spark, d), ["dataset_id"], ["l_linestatus"], NUM, ["row_id"])
    return t.select(*ROW, "l_linestatus", "l_quantity", r6("l_tax").alias("l_tax"))


@query(
    "one_hot",
    V.ctes(V.CLS, V.MISS)
    + """SELECT dataset_id, row_id, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS "l_linestatus=F",
 CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS "l_linestatus=O", l_quantity FROM miss""",
)
def one_hot(spark, d):
    return P.one_hot(V.miss(spark, d).select(*ROW, "l_linestatus", "l_quantity"), ["l_linestatus"])


@query("one_hot_index", """WITH u AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
SELECT doc_id, source, CAST(i AS BIGINT) AS source_index FROM documents LEFT JOIN u USING (source)""")
def one_hot_index(spark, d):
    t = P.one_hot_index(V.table(spark, d, "documents").select("doc_id", "source"), "source")
    return t.select("doc_id", "source", F.col("source_index").cast("bigint").alias("source_index"))


def _scale_sql(src: str, cols: list[str]) -> str:
    stats = ", ".join(f'avg("{c}") AS "m_{c}", stddev_pop("{c}") AS "s_{c}"' for c in cols)
    vals = ", ".join(f'round(("{c}" - "m_{c}") / CASE WHEN "s_{c}" > 0 THEN "s_{c}" ELSE 1 END, 6) + 0.0 AS "{c}"' for c in cols)
    return f", st AS (SELECT dataset_id, {stats} FROM {src} GROUP BY 1) SELECT dataset_id, row_id, {vals} FROM {src} JOIN st USING (dataset_id)"


@query("standardize", V.ctes(V.CLS) + _scale_sql("cls", NUM))
def standardize(spark, d):
    t = P.standardize(V.cls(spark, d), ["dataset_id"], NUM)
    return t.select(*ROW, *[r6(c).alias(c) for c in NUM])


ALL = ["l_linestatus=F", "l_linestatus=O", *NUM]


@query(
    "preprocess_all",
    V.ctes(V.CLS, V.MISS, MIXED)
    + """, oh AS (SELECT dataset_id, row_id, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS "l_linestatus=F",
 CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS "l_linestatus=O", l_quantity, l_extendedprice, l_discount, l_tax FROM mixed)"""
    + _scale_sql("oh", ALL),
)
def preprocess_all(spark, d):
    t = P.preprocess(V.miss(spark, d), ["dataset_id"], ["l_linestatus"], NUM, ["row_id"])
    return t.select(*ROW, *[r6(f"`{c}`").alias(c) for c in ALL])


@query(
    "drop_empty_cols",
    V.ctes(V.CLS, V.MISS) + "SELECT dataset_id, row_id, l_linestatus, l_tax, l_quantity FROM miss",
)
def drop_empty_cols(spark, d):
    t = V.miss(spark, d).select(*ROW, "l_linestatus", "x_empty", "l_tax", "l_quantity")
    return P.drop_empty(t, ["l_linestatus", "x_empty", "l_tax", "l_quantity"])


@query(
    "variance_threshold",
    V.ctes(V.CLS)
    + """, c AS (SELECT dataset_id, l_linestatus, label, CASE WHEN l_quantity >= 25 THEN 2 ELSE 1 END AS half, floor(l_tax) AS whole_tax, l_tax, l_discount FROM cls),
v AS (SELECT dataset_id, unnest(['half', 'whole_tax', 'l_tax', 'l_discount']) AS feature,
 unnest([var_pop(half), var_pop(whole_tax), var_pop(l_tax), var_pop(l_discount)]) AS var FROM c GROUP BY dataset_id)
SELECT dataset_id, feature, round(var, 6) AS var FROM v WHERE var > 0""",
)
def variance_threshold(spark, d):
    rows = V.cls(spark, d).withColumn("half", F.when(F.col("l_quantity") >= 25, 2).otherwise(1)).withColumn("whole_tax", F.floor("l_tax"))
    return P.varying(rows, ["dataset_id"], ["half", "whole_tax", "l_tax", "l_discount"]).withColumn("var", r6("var"))


ANOVA = V.ctes(V.CLS) + """, l AS (SELECT dataset_id, label, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature,
 unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM cls),
g AS (SELECT dataset_id, feature, label, count(*) AS n, avg(v) AS m, var_pop(v) AS var FROM l GROUP BY 1, 2, 3),
a AS (SELECT dataset_id, feature, avg(v) AS gm, count(*) AS nn FROM l GROUP BY 1, 2),
f AS (SELECT dataset_id, feature, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * var) / (max(nn) - count(*))) AS f FROM g JOIN a USING (dataset_id, feature) GROUP BY 1, 2) """


@query("anova_f", ANOVA + "SELECT dataset_id, feature, round(f, 6) AS f FROM f")
def anova_f(spark, d):
    return P.anova_f(V.cls(spark, d), ["dataset_id"], "label", NUM).withColumn("f", r6("f"))


@query(
    "select_k_best",
    ANOVA
    + """SELECT dataset_id, feature, place, round(f, 6) AS f FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY f DESC, feature) AS place FROM f) WHERE place <= 2""",
)
def select_k_best(spark, d):
    return P.select_k_best(V.cls(spark, d), ["dataset_id"], "label", NUM, 2).withColumn("f", r6("f"))


GNB_LONG = """l AS (SELECT dataset_id, label, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature,
 unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM cls),
e AS (SELECT dataset_id, 1e-9 * max(v) AS eps FROM (SELECT dataset_id, feature, var_pop(v) AS v FROM l GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "gnb_fit",
    V.ctes(V.CLS, GNB_LONG)
    + """, p AS (SELECT dataset_id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY dataset_id) AS t FROM cls GROUP BY 1, 2)
SELECT dataset_id, label, feature, round(avg(v), 6) AS mean, round(sqrt(var_pop(v) + max(eps)), 6) AS sd, round(max(n / t), 6) AS prior
FROM l JOIN e USING (dataset_id) JOIN p USING (dataset_id, label) GROUP BY 1, 2, 3""",
)
def gnb_fit(spark, d):
    m = gnb.fit(V.cls(spark, d), ["dataset_id"], "label", NUM, k=None)
    c = m.select("dataset_id", "prep", F.explode("classes").alias("c"))
    t = c.select("dataset_id", "c.label", "c.prior", F.explode("c.p").alias("z"))
    return t.select("dataset_id", "label", "z.feature", r6("z.mean").alias("mean"), r6(F.sqrt("z.var")).alias("sd"), r6("prior").alias("prior"))


def gnb_sql(src: str, fill: bool = False, scale: bool = False, agg: str = "avg({c})") -> str:
    """CTEs scoring every row of ``src`` (with fold) by the model of the other folds."""
    cols = NUM
    x = lambda c: f"coalesce({c}, f_{c})" if fill else c
    fills = ", ".join(f"{agg.format(c=c)} AS f_{c}" for c in cols)
    z = lambda c: f"(({x(c)}) - a_{c}) / CASE WHEN d_{c} > 0 THEN d_{c} ELSE 1 END" if scale else x(c)
    over = ", ".join(f"avg({x(c)}) AS a_{c}, stddev_pop({x(c)}) AS d_{c}" for c in cols)
    eps = "greatest(" + ", ".join(f"var_pop({z(c)})" for c in cols) + ")"
    per = ", ".join(f"avg({z(c)}) AS m_{c}, var_pop({z(c)}) AS v_{c}" for c in cols)
    score = "ln(n / nn)" + "".join(
        f" - 0.5 * ln(2 * pi() * (v_{c} + eps)) - 0.5 * ({z(c)} - m_{c}) * ({z(c)} - m_{c}) / (v_{c} + eps)" for c in cols
    )
    return f"""tr AS (SELECT * FROM (SELECT *, unnest(range(0, 5)) AS o FROM {src}) WHERE fold <> o),
s0 AS (SELECT dataset_id, o, {fills} FROM tr GROUP BY 1, 2),
s1 AS (SELECT dataset_id, o, {over}, count(*) AS nn FROM tr JOIN s0 USING (dataset_id, o) GROUP BY 1, 2),
s2 AS (SELECT dataset_id, o, 1e-9 * {eps} AS eps FROM tr JOIN s0 USING (dataset_id, o) JOIN s1 USING (dataset_id, o) GROUP BY 1, 2),
s3 AS (SELECT dataset_id, o, tr.label AS c, count(*) AS n, {per} FROM tr JOIN s0 USING (dataset_id, o) JOIN s1 USING (dataset_id, o) GROUP BY 1, 2, 3),
sc AS (SELECT r.dataset_id, r.row_id, r.rk, r.label, r.fold, r.l_quantity, r.l_extendedprice, s3.c, {score.replace("n / nn", "s3.n / s1.nn")} AS score
  FROM {src} r JOIN s0 ON r.dataset_id = s0.dataset_id AND r.fold = s0.o JOIN s1 ON r.dataset_id = s1.dataset_id AND r.fold = s1.o
  JOIN s2 ON r.dataset_id = s2.dataset_id AND r.fold = s2.o JOIN s3 ON r.dataset_id = s3.dataset_id AND r.fold = s3.o),
pr AS (SELECT dataset_id, row_id, rk, label, fold, l_quantity, l_extendedprice, c AS prediction FROM sc
  QUALIFY row_number() OVER (PARTITION BY dataset_id, row_id, l_quantity, l_extendedprice ORDER BY score DESC, c) = 1)"""


CV_BER = """tot AS (SELECT dataset_id, fold, count(*) AS total FROM pr GROUP BY 1, 2),
lab AS (SELECT dataset_id, fold, label AS class, count(*) AS pos, count(*) FILTER (WHERE prediction = label) AS tp FROM pr GROUP BY 1, 2, 3),
nam AS (SELECT dataset_id, fold, prediction AS class, count(*) AS named FROM pr GROUP BY 1, 2, 3),
fe AS (SELECT dataset_id, fold, avg(1 - 0.5 * tp / pos - 0.5 * (total - pos - coalesce(named, 0) + tp) / greatest(total - pos, 1e-15)) AS e
  FROM lab JOIN tot USING (dataset_id, fold) LEFT JOIN nam USING (dataset_id, fold, class) GROUP BY 1, 2)"""
CV_MEAN = "SELECT dataset_id, round(avg(e), 6) AS cv_error, count(*) AS n_folds FROM fe GROUP BY 1"


@query("gnb_predict", V.ctes(V.CLS, V.FOLDS, gnb_sql("folds")) + "SELECT dataset_id, row_id, prediction FROM pr")
def gnb_predict(spark, d):
    rows = cut(V.cls_folds(spark, d), wide=True)
    return gnb.predict(rows, gnb.fit(rows, ["dataset_id"], "label", NUM), ["dataset_id"], NUM).select(*ROW, "prediction")


@query("cv_gnb", V.ctes(V.CLS, V.FOLDS, gnb_sql("folds"), CV_BER) + CV_MEAN)
def cv_gnb(spark, d):
    rows = cut(V.cls_folds(spark, d), wide=True)
    pred = gnb.predict(rows, gnb.fit(rows, ["dataset_id"], "label", NUM), ["dataset_id"], NUM)
    return mean_fold_error(M.ber(pred, ["dataset_id", "fold"], out="error"), ["dataset_id"])


MFOLDS = V.FOLDS.replace("folds AS", "mfolds AS").replace("FROM cls", "FROM miss")


@query("cv_prepared", V.ctes(V.CLS, V.MISS, MFOLDS, gnb_sql("mfolds", fill=True, scale=True), CV_BER) + CV_MEAN)
def cv_prepared(spark, d):
    """Mean imputation and scaling refitted on the training rows of every fold."""
    from perfgrid.operators.splits import stratified_folds

    rows = cut(stratified_folds(V.miss(spark, d), "dataset_id", "label", "rk", V.TIES), wide=True)
    cols = [*NUM, "x_empty"]
    pred = gnb.predict(rows, gnb.fit(rows, ["dataset_id"], "label", cols, scale=True), ["dataset_id"], cols)
    return mean_fold_error(M.ber(pred, ["dataset_id", "fold"], out="error"), ["dataset_id"])
