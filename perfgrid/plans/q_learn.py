"""Registered queries: learners, cross-validation and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfgrid.functions import metrics as M
from perfgrid.functions.scalars import hash_order, r6
from perfgrid.operators import boost, cv, knn, linear
from perfgrid.operators import ensemble as E
from perfgrid.operators.select import mean_fold_error
from perfgrid.operators.splits import stratified_folds
from perfgrid.plans import tree_sql as TS
from perfgrid.plans import views as V
from perfgrid.plans.q_metrics import BER_TERM, CONFUSION_SQL, FOLD_ERR
from perfgrid.plans.q_prep import CV_BER, CV_MEAN, MFOLDS, NUM, gnb_sql
from perfgrid.plans.registry import query
from perfgrid.session import cut

KS = [1, 3, 5, 7, 9, 11, 13, 15]
EMB_FOLDS = """ef AS (SELECT row_id, x, label, (row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '7', row_id)), row_id) - 1) % 5 AS fold FROM emb)"""
NEAR = """dist AS (SELECT a.row_id, a.label, a.fold, b.row_id AS near_id, b.label AS near_label,
   list_sum(list_transform(list_zip(a.x, b.x), lambda t: abs(t[1] - t[2]))) AS d1, list_distance(a.x, b.x) AS d2
  FROM ef a JOIN ef b ON a.fold <> b.fold),
near AS (SELECT row_id, label, fold, near_label, 1 AS p, row_number() OVER (PARTITION BY row_id ORDER BY d1, near_id) AS place FROM dist
 UNION ALL SELECT row_id, label, fold, near_label, 2, row_number() OVER (PARTITION BY row_id ORDER BY d2, near_id) FROM dist),
kk AS (SELECT unnest([1, 3, 5, 7, 9, 11, 13, 15]) AS k),
vote AS (SELECT row_id, label, fold, p, k, near_label AS prediction FROM near JOIN kk ON place <= k GROUP BY row_id, label, fold, p, k, near_label
 QUALIFY row_number() OVER (PARTITION BY row_id, p, k ORDER BY count(*) DESC, near_label) = 1)"""


def emb_folds(spark, d):
    rows = V.emb(spark, d).withColumn("dataset_id", F.lit(0)).withColumn("rk", hash_order(V.SEED, "row_id"))
    return stratified_folds(rows, "dataset_id", "label", "rk", ["row_id"])


@query("knn_classify", V.ctes(V.EMB, EMB_FOLDS, NEAR) + "SELECT row_id, CAST(p AS INT) AS p, CAST(k AS INT) AS k, prediction FROM vote")
def knn_classify(spark, d):
    return knn.classify(emb_folds(spark, d), KS).select("row_id", "p", "k", "prediction")


@query(
    "cv_knn",
    V.ctes(V.EMB, EMB_FOLDS, NEAR)
    + """, tot AS (SELECT p, k, fold, count(*) AS total FROM vote GROUP BY 1, 2, 3),
lab AS (SELECT p, k, fold, label AS class, count(*) AS pos, count(*) FILTER (WHERE prediction = label) AS tp FROM vote GROUP BY 1, 2, 3, 4),
nam AS (SELECT p, k, fold, prediction AS class, count(*) AS named FROM vote GROUP BY 1, 2, 3, 4),
fe AS (SELECT p, k, fold, avg(1 - 0.5 * tp / pos - 0.5 * (total - pos - coalesce(named, 0) + tp) / greatest(total - pos, 1e-15)) AS e
  FROM lab JOIN tot USING (p, k, fold) LEFT JOIN nam USING (p, k, fold, class) GROUP BY 1, 2, 3)
SELECT CAST(p AS INT) AS p, CAST(k AS INT) AS k, round(avg(e), 6) AS cv_error, count(*) AS n_folds FROM fe GROUP BY 1, 2""",
)
def cv_knn(spark, d):
    pred = knn.classify(emb_folds(spark, d), KS)
    return mean_fold_error(M.ber(pred, ["p", "k", "fold"], out="error"), ["p", "k"])


def _perceptron_sql() -> str:
    stats = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS d_{c}" for c in NUM)
    z = ", ".join(f"({c} - a_{c}) / CASE WHEN d_{c} > 0 THEN d_{c} ELSE 1 END AS z_{c}" for c in NUM)
    first = "sum(y) AS w0, " + ", ".join(f"sum(y * z_{c}) AS w_{c}" for c in NUM)
    score = "w0 + " + " + ".join(f"w_{c} * z_{c}" for c in NUM)
    second = "CASE WHEN y * s <= 0 THEN y ELSE 0 END"
    return (
        V.ctes(V.CLS)
        + f""", st AS (SELECT dataset_id, {stats} FROM cls GROUP BY 1), zz AS (SELECT dataset_id, label, {z} FROM cls JOIN st USING (dataset_id)),
ov AS (SELECT zz.*, c, CASE WHEN label = c THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS y FROM zz, (SELECT unnest(['A', 'N', 'R']) AS c)),
w1 AS (SELECT dataset_id, c, {first} FROM ov GROUP BY 1, 2),
sc AS (SELECT ov.*, {score} AS s FROM ov JOIN w1 USING (dataset_id, c)),
w2 AS (SELECT dataset_id, c, sum({second}) AS u0, {", ".join(f"sum({second} * z_{c}) AS u_{c}" for c in NUM)} FROM sc GROUP BY 1, 2)
SELECT dataset_id, c AS label, round(w0 + u0, 4) + 0.0 AS bias, {", ".join(f"round(w_{c} + u_{c}, 4) + 0.0 AS {c}" for c in NUM)} FROM w1 JOIN w2 USING (dataset_id, c)"""
    )


@query("perceptron_epoch", _perceptron_sql())
def perceptron_epoch(spark, d):
    """Weights of all one-vs-rest perceptrons after two full-batch epochs."""
    s = linear.fit(V.cls(spark, d), ["dataset_id"], "label", NUM, "perceptron", k=None, epochs=2)
    r4 = lambda c: F.round(c, 4) + 0.0
    return s.select("dataset_id", "label", r4(F.col("w")[0]).alias("bias"), *[r4(F.col("w")[j + 1]).alias(c) for j, c in enumerate(NUM)])


@query(
    "ridge_1d",
    V.ctes(V.CLS)
    + """SELECT dataset_id, round(count(*) * covar_pop(l_extendedprice, l_quantity) / (count(*) * var_pop(l_quantity) + 100.0), 4) AS slope,
 round(avg(l_extendedprice) - count(*) * covar_pop(l_extendedprice, l_quantity) / (count(*) * var_pop(l_quantity) + 100.0) * avg(l_quantity), 4) AS intercept FROM cls GROUP BY 1""",
)
def ridge_1d(spark, d):
    t = linear.ridge(V.cls(spark, d), ["dataset_id"], "l_quantity", "l_extendedprice", 100.0)
    return t.select("dataset_id", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


def _stump_sql() -> str:
    return (
        V.ctes(V.CLS)
        + """, l AS (SELECT dataset_id, label, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature,
 unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM cls),
cells AS (SELECT dataset_id, feature, v, count(*) FILTER (WHERE label = 'A') AS a, count(*) FILTER (WHERE label = 'N') AS n, count(*) FILTER (WHERE label = 'R') AS r FROM l GROUP BY 1, 2, 3),
run AS (SELECT dataset_id, feature, v, CAST(sum(a) OVER w AS DOUBLE) AS la, CAST(sum(n) OVER w AS DOUBLE) AS ln_, CAST(sum(r) OVER w AS DOUBLE) AS lr,
 CAST(sum(a) OVER g AS DOUBLE) - sum(a) OVER w AS ra, CAST(sum(n) OVER g AS DOUBLE) - sum(n) OVER w AS rn, CAST(sum(r) OVER g AS DOUBLE) - sum(r) OVER w AS rr, lead(v) OVER w AS nxt
 FROM cells WINDOW w AS (PARTITION BY dataset_id, feature ORDER BY v ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY dataset_id, feature)),
sp AS (SELECT *, la + ln_ + lr AS nl, ra + rn + rr AS nr FROM run WHERE nxt IS NOT NULL),
gi AS (SELECT *, round((nl - (la*la + ln_*ln_ + lr*lr) / nl + nr - (ra*ra + rn*rn + rr*rr) / nr) / (nl + nr), 12) AS gini,
 1 - (greatest(la, ln_, lr) + greatest(ra, rn, rr)) / (nl + nr) AS err FROM sp),
b AS (SELECT * FROM gi QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY gini, feature, v) = 1)
SELECT dataset_id, feature, round((v + nxt) / 2, 6) AS threshold, CASE WHEN la >= ln_ AND la >= lr THEN 'A' WHEN ln_ >= lr THEN 'N' ELSE 'R' END AS low,
 CASE WHEN ra >= rn AND ra >= rr THEN 'A' WHEN rn >= rr THEN 'N' ELSE 'R' END AS high, round(err, 6) AS error, round(ln((1 - err) / err) + ln(2), 6) AS alpha FROM b"""
    )


@query("ada_round1", _stump_sql())
def ada_round1(spark, d):
    s = boost.adaboost(V.cls(spark, d), ["dataset_id"], "label", NUM, 1)
    t = s.select("dataset_id", F.explode("stumps").alias("t"))
    return t.select("dataset_id", "t.feature", r6("t.threshold").alias("threshold"), "t.low", "t.high", r6("t.error").alias("error"), r6("t.alpha").alias("alpha"))


ADA_TEN = (
    V.ctes(V.CLS, *TS.ada_rounds(10, NUM, "cls", by_name=True))
    + ", pr AS (SELECT dataset_id, 0 AS fold, label, CASE WHEN va + vn + vr = 0 THEN NULL WHEN round(va, 9) >= round(vn, 9) AND round(va, 9) >= round(vr, 9) THEN 'A' WHEN round(vn, 9) >= round(vr, 9) THEN 'N' ELSE 'R' END AS prediction FROM q10), "
    + CV_BER
    + ", ns AS ("
    + " UNION ALL ".join(f"SELECT dataset_id FROM st{i} WHERE alpha > 0" for i in range(10))
    + ") SELECT dataset_id, round(e, 6) AS ber, (SELECT count(*) FROM ns WHERE ns.dataset_id = fe.dataset_id)::INT AS n_stumps FROM fe"
)


@query("adaboost", ADA_TEN)
def adaboost(spark, d):
    """Ten boosting rounds on every dataset and the training error of the vote."""
    rows = V.cls(spark, d)
    s = boost.adaboost(rows, ["dataset_id"], "label", NUM, 10)
    pred = boost.predict(rows, s, ["dataset_id"], NUM)
    return M.ber(pred, ["dataset_id"]).withColumn("ber", r6("ber")).join(s.select("dataset_id", F.size("stumps").alias("n_stumps")), "dataset_id")


SMALL = [c for c in cv.FAMILY if c["reducer"] is None and c["imputer"] != "most_frequent"]
FILLS = {"mean": "avg({c})", "median": "median({c})", "constant": "CAST(0 AS DOUBLE)"}
WEIGHTS = {"mean": 1.0, "median": 3.0, "constant": 0.8}


def _perf_table_sql() -> str:
    """One scored block per config; the cost is cells read times the config's weight."""
    parts = []
    for c in SMALL:
        w = WEIGHTS[c["imputer"]] + (0.3 if c["scale"] else 0.0) + 0.5
        body = gnb_sql("mfolds", fill=True, scale=c["scale"], agg=FILLS[c["imputer"]])
        parts.append(
            f"""SELECT e.dataset_id, CAST({c['config_id']} AS INT) AS config_id, round(e.error, 6) AS error, round({w} * n.n * 5 / 10000.0, 6) AS runtime, 'ok' AS status
FROM (WITH {body}, {CV_BER} SELECT dataset_id, avg(e) AS error FROM fe GROUP BY 1) e JOIN (SELECT dataset_id, count(*) AS n FROM miss GROUP BY 1) n USING (dataset_id)"""
        )
    return V.ctes(V.CLS, V.MISS, MFOLDS) + " UNION ALL ".join(parts)


@query("perf_table", _perf_table_sql())
def perf_table(spark, d):
    """Error and cost of every (dataset, config); a first half is already stored and skipped."""
    rows = cut(stratified_folds(V.miss(spark, d), "dataset_id", "label", "rk", V.TIES), wide=True)
    cols = [*NUM, "x_empty"]
    done = cut(cv.perf_table(rows, ["dataset_id"], "label", cols, SMALL[:2]))
    rest = cv.perf_table(rows, ["dataset_id"], "label", cols, SMALL, done=done)
    t = done.unionByName(rest)
    return t.select("dataset_id", "config_id", r6("error").alias("error"), r6("runtime").alias("runtime"), "status")


@query("perf_table_family")
def perf_table_family(spark, d):
    """The same for the whole family of forty configs, with scaling and feature selection."""
    rows = cut(stratified_folds(V.miss(spark, d), "dataset_id", "label", "rk", V.TIES), wide=True)
    return cv.perf_table(rows, ["dataset_id"], "label", [*NUM, "x_empty"], cv.FAMILY)


# Ensembles -----------------------------------------------------------------------------------------------------------

VOTE_SQL = """vt AS (SELECT dataset_id, row_id, l_quantity, l_extendedprice, label, prediction AS vote FROM pred GROUP BY 1, 2, 3, 4, 5, 6
 QUALIFY row_number() OVER (PARTITION BY dataset_id, row_id, l_quantity, l_extendedprice ORDER BY count(*) DESC, prediction) = 1)"""
ROW = ["dataset_id", "row_id", *V.TIES]


@query("majority_vote", V.ctes(V.CLS, V.PRED, VOTE_SQL) + "SELECT dataset_id, row_id, vote AS prediction FROM vt")
def majority_vote(spark, d):
    pred = V.pred(spark, d)
    return E.majority_vote(pred, ROW, labels=E.listed(pred, ["prediction"])).select("dataset_id", "row_id", "prediction")


MEMBER_BER = V.ctes(V.CLS, V.PRED, CONFUSION_SQL) + f", mb AS (SELECT dataset_id, member, avg({BER_TERM}) AS e FROM conf GROUP BY 1, 2)"


@query("member_scores", MEMBER_BER + "SELECT dataset_id, member, round(e, 3) AS score FROM mb")
def member_scores(spark, d):
    return E.member_errors(V.pred(spark, d)).select("dataset_id", "member", F.round("error", 3).alias("score"))


@query(
    "best_several",
    V.ctes(V.PERF, V.STATUS)
    + """SELECT dataset_id, slot, config_id FROM (SELECT dataset_id, config_id, row_number() OVER (PARTITION BY dataset_id ORDER BY error, config_id) AS slot
 FROM stat WHERE error IS NOT NULL) WHERE slot <= 3""",
)
def best_several(spark, d):
    t = E.best_several(V.with_status(V.perf(spark, d)), 3, "config_id")
    return t.select("dataset_id", "slot", "config_id")


STEP_SQL = (
    MEMBER_BER
    + """, rk3 AS (SELECT dataset_id, member, row_number() OVER (PARTITION BY dataset_id ORDER BY e, member) AS r FROM mb),
base AS (SELECT p.dataset_id, p.row_id, p.l_quantity, p.l_extendedprice, p.label, p.prediction FROM pred p JOIN rk3 USING (dataset_id, member) WHERE r <= 3),
al AS (SELECT p.dataset_id, p.row_id, p.l_quantity, p.l_extendedprice, p.label, p.member AS cand, b.prediction FROM pred p
   JOIN base b ON p.dataset_id = b.dataset_id AND p.row_id = b.row_id AND p.l_quantity = b.l_quantity AND p.l_extendedprice = b.l_extendedprice
 UNION ALL SELECT dataset_id, row_id, l_quantity, l_extendedprice, label, member, prediction FROM pred),
vv AS (SELECT dataset_id, cand, label, prediction FROM al GROUP BY dataset_id, row_id, l_quantity, l_extendedprice, label, cand, prediction
 QUALIFY row_number() OVER (PARTITION BY dataset_id, row_id, l_quantity, l_extendedprice, cand ORDER BY count(*) DESC, prediction) = 1),
vt AS (SELECT dataset_id, cand, count(*) AS total FROM vv GROUP BY 1, 2),
vl AS (SELECT dataset_id, cand, label AS class, count(*) AS pos, count(*) FILTER (WHERE prediction = label) AS tp FROM vv GROUP BY 1, 2, 3),
vn AS (SELECT dataset_id, cand, prediction AS class, count(*) AS named FROM vv GROUP BY 1, 2, 3)
SELECT dataset_id, cand AS member, round(avg(1 - 0.5 * tp / pos - 0.5 * (total - pos - coalesce(named, 0) + tp) / greatest(total - pos, 1e-15)), 6) AS error
FROM vl JOIN vt USING (dataset_id, cand) LEFT JOIN vn USING (dataset_id, cand, class) GROUP BY 1, 2"""
)


@query("greedy_step", STEP_SQL)
def greedy_step(spark, d):
    pred = V.pred(spark, d)
    chosen = E.start(E.member_errors(pred), 3)
    return E.step_errors(E.patterns(E.pack(pred, ROW, votes=E.listed(pred, ["member", "prediction"]))), chosen).withColumn("error", r6("error"))


def _greedy_sql(steps: int = 2) -> str:
    """Two more members for the three best: the votes of a list of members follow from counts of equal votes."""
    hits = {c: f"len(list_filter(list_transform(ms, lambda m: v[m]), lambda x: x = '{c}'))" for c in "ANR"}
    vote = f"CASE WHEN {hits['A']} >= {hits['N']} AND {hits['A']} >= {hits['R']} THEN 'A' WHEN {hits['N']} >= {hits['R']} THEN 'N' ELSE 'R' END"

    def scored(name: str, lists: str) -> str:
        """Error of each list ``ms`` (with its candidate) of the table ``lists``."""
        return f"""{name}v AS (SELECT l.dataset_id, l.cand, label, {vote} AS p, n FROM {lists} l JOIN pat USING (dataset_id)),
{name}t AS (SELECT dataset_id, cand, sum(n) AS total FROM {name}v GROUP BY 1, 2), {name}l AS (SELECT dataset_id, cand, label AS class, sum(n) AS pos, coalesce(sum(n) FILTER (WHERE p = label), 0) AS tp FROM {name}v GROUP BY 1, 2, 3),
{name}n AS (SELECT dataset_id, cand, p AS class, sum(n) AS named FROM {name}v GROUP BY 1, 2, 3),
{name}e AS (SELECT dataset_id, cand, avg(1 - 0.5 * tp / pos - 0.5 * (total - pos - coalesce(named, 0) + tp) / greatest(total - pos, 1e-15)) AS e
  FROM {name}l JOIN {name}t USING (dataset_id, cand) LEFT JOIN {name}n USING (dataset_id, cand, class) GROUP BY 1, 2)"""

    parts = [
        "sid AS (SELECT dataset_id, label, list(prediction ORDER BY member) AS v FROM pred GROUP BY dataset_id, row_id, l_quantity, l_extendedprice, label)",
        "pat AS (SELECT dataset_id, label, v, count(*) AS n FROM sid GROUP BY ALL)",
        "rk AS (SELECT dataset_id, member, row_number() OVER (PARTITION BY dataset_id ORDER BY e, member) AS r FROM mb)",
        "i0 AS (SELECT dataset_id, 0 AS cand, list(member ORDER BY r) AS ms FROM rk WHERE r <= 3 GROUP BY 1)",
        scored("a0", "i0"),
        "s0 AS (SELECT dataset_id, ms, e FROM i0 JOIN a0e USING (dataset_id))",
    ]
    for i in range(1, steps + 1):
        parts += [
            f"i{i} AS (SELECT dataset_id, member AS cand, list_append(ms, member) AS ms FROM s{i - 1} JOIN rk USING (dataset_id))",
            scored(f"a{i}", f"i{i}"),
            f"b{i} AS (SELECT dataset_id, cand, a.e FROM a{i}e a JOIN s{i - 1} s USING (dataset_id) JOIN rk ON rk.dataset_id = a.dataset_id AND rk.member = a.cand WHERE round(a.e, 12) < round(s.e, 12) "
            f"QUALIFY row_number() OVER (PARTITION BY a.dataset_id ORDER BY r) = 1)".replace("SELECT dataset_id, cand", "SELECT a.dataset_id, a.cand"),
            f"s{i} AS (SELECT s.dataset_id, CASE WHEN b.cand IS NULL THEN ms ELSE list_append(ms, b.cand) END AS ms, coalesce(b.e, s.e) AS e FROM s{i - 1} s LEFT JOIN b{i} b USING (dataset_id))",
        ]
    return MEMBER_BER + ", " + ", ".join(parts) + f" SELECT dataset_id, array_to_string(ms, ',') AS members, round(e, 6) AS error FROM s{steps}"


@query("greedy_select", _greedy_sql())
def greedy_select(spark, d):
    return E.greedy_select(V.pred(spark, d), ROW, 5).select("dataset_id", F.array_join("chosen", ",").alias("members"), r6("error").alias("error"))


SIDE = "SELECT dataset_id, row_id, " + ", ".join(f"max(CASE WHEN member = {m} THEN prediction END) AS {{p}}{m}" for m in V.MEMBERS)
SIDE += " FROM pred GROUP BY dataset_id, row_id, l_quantity, l_extendedprice"


@query("collection_predict", V.ctes(V.CLS, V.PRED) + SIDE.format(p="m"))
def collection_predict(spark, d):
    return E.side_by_side(V.pred(spark, d), ROW, V.MEMBERS).drop(*V.TIES)


@query(
    "stack_features",
    V.ctes(V.CLS, V.PRED)
    + "SELECT dataset_id, row_id, label, "
    + ", ".join(f"max(CASE WHEN member = {m} AND prediction = '{c}' THEN 1 ELSE 0 END) AS f{m}_{c}" for m in V.MEMBERS for c in "ANR")
    + " FROM pred GROUP BY dataset_id, row_id, l_quantity, l_extendedprice, label",
)
def stack_features(spark, d):
    from perfgrid.operators.prep import one_hot

    wide = E.side_by_side(V.pred(spark, d), [*ROW, "label"], V.MEMBERS, prefix="f").drop(*V.TIES)
    levels = {f"f{m}": list("ANR") for m in V.MEMBERS}
    hot = one_hot(wide, list(levels), levels)
    return hot.select("dataset_id", "row_id", "label", *[F.col(f"`f{m}={c}`").cast("int").alias(f"f{m}_{c}") for m in V.MEMBERS for c in "ANR"])


@query(
    "describe_models",
    V.ctes(V.PERF_CONF)
    + """, b AS (SELECT * FROM perf_conf QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY error, config_id) <= 8)
SELECT dataset_id, algorithm, count(*) AS n_members, string_agg('size=' || size, ', ' ORDER BY 'size=' || size) AS members FROM b GROUP BY 1, 2""",
)
def describe_models(spark, d):
    best = E.best_several(V.perf_conf(spark, d), 8, "config_id")
    text = F.concat(F.lit("size="), F.col("hyperparameters")["size"])
    return E.describe(best.withColumn("description", text))


@query(
    "cv_ensemble",
    V.ctes(V.CLS, V.FOLDS, V.PRED, VOTE_SQL)
    + ", "
    + FOLD_ERR.replace("p.member", "1 AS member").replace("p.prediction FROM pred p", "p.vote AS prediction FROM vt p")
    + "SELECT dataset_id, round(avg(e), 6) AS cv_error, count(*) AS n_folds FROM fe GROUP BY 1",
)
def cv_ensemble(spark, d):
    m = F.col("member")
    rows = V.cls_folds(spark, d).withColumn("member", F.explode(F.array(*[F.lit(i) for i in V.MEMBERS])))
    rows = rows.withColumn("prediction", F.when(F.col("l_quantity") > 8 * m, "A").when(F.col("l_discount") > F.lit(0.02) * m, "N").otherwise("R"))
    vote = E.majority_vote(rows, [*ROW, "fold", "label"], labels=E.listed(V.pred(spark, d), ["prediction"]))
    return mean_fold_error(M.ber(vote, ["dataset_id", "fold"], out="error"), ["dataset_id"])
