"""Registered queries: batched learners over many datasets, and the whole grid in one table."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfgrid.functions import metrics as M
from perfgrid.functions.scalars import hash_order, r6
from perfgrid.operators import blocks as B
from perfgrid.operators import neighbours
from perfgrid.operators import runner as R
from perfgrid.operators.ensemble import side_by_side
from perfgrid.operators.prep import one_hot
from perfgrid.operators.select import mean_fold_error
from perfgrid.operators.splits import stratified_folds
from perfgrid.plans import tree_sql as T
from perfgrid.plans import views as V
from perfgrid.plans.q_learn import ROW
from perfgrid.plans.q_prep import CV_BER, CV_MEAN, NUM
from perfgrid.plans.registry import query
from perfgrid.session import cut, stored
from perfgrid.sources.grids import ESTIMATORS, settings

DATASET = ["dataset_id"]
COLS = T.F4


def row_key():
    """The first sixty bits of the row hash."""
    return F.conv(F.substring("rk", 1, 15), 16, 10).cast("long")


def kept(rows, cols):
    """Rows with what blocks hold only: they are written once and read for each statistic."""
    return cut(rows.select(*DATASET, "label", "fold", row_key().alias("key"), *cols), wide=True)


def priced(rows):
    return rows.withColumn("price", F.floor(F.col("l_extendedprice") / 10000).cast("double"))


def rows_of(spark, d, cols=COLS):
    return kept(priced(V.cls_folds(spark, d)), cols)


def blocks_of(spark, d, cols=COLS, k=5, edges=True):
    return B.pack_folded(priced(V.cls(spark, d)), DATASET, "label", cols, "rk", V.TIES, k, edges=edges)


def one_config(b, algorithm: str, h: dict, k: int | None = 5):
    """(tasks, models) of one configuration on every dataset."""
    tasks = R.tasks_of(b.info, DATASET, [{"config_id": 0, "algorithm": algorithm, "hyperparameters": h}])
    return tasks, R.fit(b, tasks, k)


def cv_of(b, algorithm: str, h: dict):
    tasks, models = one_config(b, algorithm, h)
    return mean_fold_error(M.ber_of_counts(R.confusion(b, tasks, models), [*DATASET, "fold"], "error"), DATASET)


def _base(*parts: str) -> str:
    return V.ctes(V.CLS, V.FOLDS, T.BASE, *parts)


def _named(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(COLS)) + " END"


SPLITS = _base(*T.forest(1, 2, None, False, False, folds=False)) + " UNION ALL ".join(
    f"SELECT dataset_id, path AS place, {_named('f')} AS feature, round(cut, 6) AS cut, NULL::VARCHAR AS label, NULL::DOUBLE AS weight FROM s{n}" for n in range(2)
) + """ UNION ALL SELECT dataset_id, path, NULL, NULL, CASE WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END, a + n + r FROM leaf"""


@query("tree_splits", SPLITS)
def tree_splits(spark, d):
    """Splits and leaves of the trees of depth two of all datasets, grown together."""
    b = blocks_of(spark, d, k=None)
    _, models = one_config(b, "DT", {"max_depth": "2"}, None)
    t, leaf = B.model_table(models, DATASET, COLS), F.col("feature").isNull()
    return t.select("dataset_id", "place", "feature", r6("cut").alias("cut"), F.when(leaf, F.col("label")).alias("label"), F.when(leaf, F.col("value")).alias("weight"))


@query("cv_tree", _base(*T.forest(1, 3, None, False, False, 64), CV_BER) + CV_MEAN)
def cv_tree(spark, d):
    return cv_of(blocks_of(spark, d), "DT", {"max_depth": "3", "min_samples_split": "64"})


@query("cv_forest", _base(*T.forest(5, 3, 2, True, False), CV_BER) + CV_MEAN)
def cv_forest(spark, d):
    """Five sampled trees a fold; samples and feature subsets follow from hashes."""
    return cv_of(blocks_of(spark, d), "RF", {"n_estimators": "5", "max_depth": "3"})


@query("cv_extra_trees", _base(*T.forest(5, 3, 2, False, True), CV_BER) + CV_MEAN)
def cv_extra_trees(spark, d):
    return cv_of(blocks_of(spark, d), "ExtraTrees", {"n_estimators": "5", "max_depth": "3"})


GBT = _base(*T.boosting(2)) + "SELECT dataset_id, cls AS label, path AS place, round(value, 6) + 0.0 AS value FROM lv JOIN pri USING (dataset_id, tree)"


@query("gbt_round1", GBT)
def gbt_round1(spark, d):
    """Leaf values of the first round, a tree for each class of each dataset."""
    b = blocks_of(spark, d, k=None)
    _, models = one_config(b, "GBT", {"max_depth": "2", "n_estimators": "1"}, None)
    t = B.model_table(models, DATASET, COLS).filter("feature IS NULL")
    return t.select("dataset_id", "label", "place", r6("value").alias("value"))


ADA = _base(*T.ada_rounds(3)) + " UNION ALL ".join(
    f"SELECT dataset_id, {n} AS round, {_named('f')} AS feature, round(cut, 6) AS cut, low, high, round(alpha, 6) AS alpha FROM st{n}" for n in range(3)
)


@query("ada_rounds", ADA)
def ada_rounds(spark, d):
    """The first three stumps of every dataset with their say."""
    b = blocks_of(spark, d, k=None)
    _, models = one_config(b, "AB", {"n_estimators": "3"}, None)
    t = B.model_table(models, DATASET, COLS)
    side = lambda p: F.max(F.when(F.col("place") == p, F.col("label")))
    out = t.groupBy("dataset_id", "round").agg(F.max("feature").alias("feature"), F.max(r6("cut")).alias("cut"), side(2).alias("low"), side(3).alias("high"), F.max(r6("value")).alias("alpha"))
    return out.select("dataset_id", "round", "feature", "cut", "low", "high", "alpha")


# Convex learners: the optimum itself, found by different Newton steps in SQL -------------------------------------------


def _optimum(algorithm: str, h: dict):
    def run(spark, d):
        b = blocks_of(spark, d, NUM, edges=False)
        _, models = one_config(b, algorithm, h)
        t = B.model_table(models, DATASET, NUM)
        # zeros of the last places have no sign
        w = t.filter("round = 0").select("dataset_id", "outer", "label", F.coalesce("feature", F.lit("bias")).alias("feature"), (F.round("value", 4) + 0.0).alias("weight"))
        worst = t.filter("round = 1").groupBy("dataset_id", "outer", "label").agg((F.max("value") < 1e-6).alias("settled"))
        return w.join(worst, ["dataset_id", "outer", "label"])

    return run


def _optimum_sql(loss: str, steps: int) -> str:
    rows = [f"SELECT dataset_id, CAST(o AS INT) AS outer, c AS label, '{f}' AS feature, round(w{j}, 4) + 0.0 AS weight, true AS settled FROM m{steps}" for j, f in enumerate(["bias", *NUM])]
    return V.ctes(V.CLS, V.FOLDS, *T.newton(loss, 1.0, steps, NUM, "folds")) + " UNION ALL ".join(rows)


query("logistic_optimum", _optimum_sql("logistic", 7))(_optimum("Logit", {"C": "1", "penalty": "l2"}))
query("svm_optimum", _optimum_sql("squared_hinge", 12))(_optimum("lSVM", {"C": "1"}))


@query("cv_logistic", V.ctes(V.CLS, V.FOLDS, *T.newton("logistic", 1.0, 7, NUM, "folds"), CV_BER) + CV_MEAN)
def cv_logistic(spark, d):
    """All datasets, folds and classes of a logistic model trained together to the optimum."""
    b = blocks_of(spark, d, NUM, edges=False)
    return cv_of(b, "Logit", {"C": "1", "penalty": "l2"})


@query("cv_svm", V.ctes(V.CLS, V.FOLDS, *T.newton("squared_hinge", 1.0, 12, NUM, "folds"), CV_BER) + CV_MEAN)
def cv_svm(spark, d):
    b = blocks_of(spark, d, NUM, edges=False)
    return cv_of(b, "lSVM", {"C": "1"})


# Nearest neighbours of many datasets --------------------------------------------------------------------------------

KS, PS = [1, 5, 15], [1, 2]
NEAR = f"""kf AS (SELECT l_suppkey AS dataset_id, l_quantity, l_discount * 100 AS disc, l_tax * 100 AS tax, l_returnflag AS label,
  md5(concat_ws('|', '{V.SEED}', l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS rk, l_extendedprice FROM lineitem),
kr AS (SELECT *, (row_number() OVER (PARTITION BY dataset_id, label ORDER BY rk, l_quantity, l_extendedprice) - 1) % 5 AS fold,
  CAST('0x' || substr(rk, 1, 15) AS BIGINT) AS key FROM kf),
ds AS (SELECT a.dataset_id, a.key AS q, a.label, a.fold, b.key AS near, b.label AS near_label,
  abs(a.l_quantity - b.l_quantity) + abs(a.disc - b.disc) + abs(a.tax - b.tax) AS d1,
  (a.l_quantity - b.l_quantity) ** 2 + (a.disc - b.disc) ** 2 + (a.tax - b.tax) ** 2 AS d2
  FROM kr a JOIN kr b ON a.dataset_id = b.dataset_id AND a.fold <> b.fold),
nr AS (SELECT dataset_id, q, label, fold, near_label, 1 AS p, row_number() OVER (PARTITION BY dataset_id, q ORDER BY round(d1, 9), near) AS place FROM ds QUALIFY place <= 15
 UNION ALL SELECT dataset_id, q, label, fold, near_label, 2, row_number() OVER (PARTITION BY dataset_id, q ORDER BY round(d2, 9), near) AS place FROM ds QUALIFY place <= 15),
vo AS (SELECT dataset_id, q, label, fold, p, k, near_label AS prediction FROM nr JOIN (SELECT unnest([1, 5, 15]) AS k) ON place <= k
 GROUP BY dataset_id, q, label, fold, p, k, near_label QUALIFY row_number() OVER (PARTITION BY dataset_id, q, p, k ORDER BY count(*) DESC, near_label) = 1)"""


@query(
    "knn_many",
    V.ctes(NEAR) + "SELECT dataset_id, CAST(p AS INT) AS p, CAST(k AS INT) AS k, CAST(fold AS INT) AS fold, label, prediction, count(*) AS n FROM vo GROUP BY ALL",
)
def knn_many(spark, d):
    """Out-of-fold confusion of nearest neighbours inside every supplier's rows, all k and both distances at once."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = V.table(spark, d, "lineitem").withColumn("rk", hash_order(V.SEED, *keys))
    # whole hundredths, so that equal distances are equal numbers
    rows = li.select(F.col("l_suppkey").alias("dataset_id"), "rk", "l_quantity", "l_extendedprice", F.round(F.col("l_discount") * 100).alias("disc"), F.round(F.col("l_tax") * 100).alias("tax"), F.col("l_returnflag").alias("label"))
    cols = ["l_quantity", "disc", "tax"]
    rows = kept(stratified_folds(rows, "dataset_id", "label", "rk", V.TIES), cols)
    b = B.pack(rows, DATASET, "label", cols, F.col("key"), 5, edges=False)
    names = b.info.filter("outer = -1").select("dataset_id", "classes")
    t = neighbours.confusion(b, KS, PS).join(names, "dataset_id")
    return t.select("dataset_id", "p", "k", "fold", F.get("classes", F.col("_y")).alias("label"), F.get("classes", F.col("_p")).alias("prediction"), F.col("_n").alias("n"))


# The grid -----------------------------------------------------------------------------------------------------------

#: one configuration of the grid for each of its algorithms, the one that gives the smallest trees
CHOSEN = {"DT": {"min_samples_split": "1024"}, "RF": {"min_samples_split": "1024", "criterion": "gini"}, "ExtraTrees": {"min_samples_split": "1024", "criterion": "entropy"}}


def grid_configs() -> list[dict]:
    """The first configuration of each algorithm that agrees with ``CHOSEN``, under its number in the grid."""
    out, seen = [], set()
    for i, c in enumerate(settings(ESTIMATORS)):
        want = CHOSEN.get(c["algorithm"], {})
        if c["algorithm"] not in seen and all(c["hyperparameters"].get(k) == v for k, v in want.items()):
            seen.add(c["algorithm"])
            out.append({"config_id": i, **c})
    return out


@query("perf_grid")
def perf_grid(spark, d):
    """Error, cost and status of one configuration of every algorithm on every dataset. The first four are
    measured before and found done."""
    b = B.pack(rows_of(spark, d), DATASET, "label", COLS, F.col("key"))  # networks depend on how rows are dealt to blocks
    configs = grid_configs()
    done = cut(R.performance(b, R.tasks_of(b.info, DATASET, configs[:4])))
    rest = R.performance(b, R.tasks_of(b.info, DATASET, configs), done=done)
    t = done.unionByName(rest)
    return t.select("dataset_id", "config_id", r6("error").alias("error"), r6("runtime").alias("runtime"), "status")


@query("stacking")
def stacking(spark, d):
    """Second level on the members' out-of-fold predictions: a logistic model for each dataset and left-out
    fold, scored on rows it was not fitted on."""
    wide = side_by_side(V.pred(spark, d), [*ROW, "label", "rk"], V.MEMBERS, prefix="f")
    wide = stored(wide.select(*DATASET, "label", F.unhex("rk").alias("rk"), *V.TIES, *[f"f{m}" for m in V.MEMBERS]), "members")
    hot = one_hot(wide.withColumn("rk", F.lower(F.hex("rk"))), [f"f{m}" for m in V.MEMBERS], {f"f{m}": list("ANR") for m in V.MEMBERS})
    names = {f"f{m}={c}": f"f{m}_{c}" for m in V.MEMBERS for c in "ANR"}
    hot = hot.withColumnsRenamed(names)
    b = B.pack_folded(hot, DATASET, "label", list(names.values()), "rk", V.TIES, 5, edges=False)
    tasks, models = one_config(b, "Logit", {"C": "1", "penalty": "l2"})
    worst = B.model_table(models, DATASET, b.cols).filter("round = 1").groupBy("dataset_id").agg((F.max("value") < 1e-6).alias("settled"))
    cv = mean_fold_error(M.ber_of_counts(R.confusion(b, tasks, models), [*DATASET, "fold"], "error"), DATASET)
    return cv.join(worst, "dataset_id")
