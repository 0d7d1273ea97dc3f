"""Registered queries: learners backed by Spark ML, on the labelled documents."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from perfgrid.functions.scalars import hash_order
from perfgrid.operators import mllib
from perfgrid.operators.splits import holdout
from perfgrid.plans import views as V
from perfgrid.plans.registry import query
from perfgrid.session import cut

PLAIN = {
    "imputer": {"algorithm": "SimpleImputer", "hyperparameters": {"strategy": "mean"}},
    "encoder": {"algorithm": "OneHotEncoder", "hyperparameters": {}},
    "standardizer": {"algorithm": "StandardScaler", "hyperparameters": {}},
    "dim_reducer": {"algorithm": None, "hyperparameters": {}},
}


def _parts(spark, d):
    rows = V.docs(spark, d).withColumn("dataset_id", F.lit(0)).withColumn("rk", hash_order(V.SEED, "doc_id"))
    rows = cut(holdout(rows, ["dataset_id"], "label", "rk", ["doc_id"]).select("doc_id", "n_chars", "lang", "source", "label", "part"))
    return rows.filter("part = 'train'").drop("part"), rows.filter("part = 'test'").drop("part")


def _learn(algorithm: str, hyperparameters: dict, **steps):
    config = {**PLAIN, **steps, "estimator": {"algorithm": algorithm, "hyperparameters": hyperparameters}}

    def run(spark, d):
        train, test = _parts(spark, d)
        return mllib.fit_predict(train, test, config, ["n_chars"], ["lang", "source"]).select("doc_id", "label", "prediction")

    return run


query("logistic")(_learn("Logit", {"C": "1", "penalty": "l2"}))
query("linear_svm")(_learn("lSVM", {"C": "1"}))
query("decision_tree")(_learn("DT", {"min_samples_split": "8"}))
query("random_forest")(_learn("RF", {"min_samples_split": "0.01", "criterion": "entropy"}))
query("extra_trees")(_learn("ExtraTrees", {"min_samples_split": "4", "criterion": "gini"}))
query("gradient_boosting")(_learn("GBT", {"learning_rate": "0.1", "max_depth": "3", "n_estimators": "50"}))
query("mlp")(_learn("MLP", {"learning_rate_init": "0.01", "solver": "adam"}))
query("prep_fit_predict")(
    _learn(
        "Logit", {"C": "2", "penalty": "l1"}, imputer={"algorithm": "SimpleImputer", "hyperparameters": {"strategy": "median"}},
        dim_reducer={"algorithm": "SelectKBest", "hyperparameters": {"k": "75%"}},
    )
)


def _ridge_sql(alpha: float) -> str:
    """Normal equations of three centred features by Cramer's rule."""
    x = ["l_quantity", "l_discount", "l_tax"]
    sums = [f"covar_pop({a}, {b}) * count(*) AS s{i}{j}" for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    sums += [f"covar_pop({a}, l_extendedprice) * count(*) AS t{i}" for i, a in enumerate(x)] + [f"avg({a}) AS m{i}" for i, a in enumerate(x)]

    def cell(i: int, j: int, col: int | None) -> str:
        if col == j:
            return f"t{i}"
        return f"(s{min(i, j)}{max(i, j)} + {alpha if i == j else 0})"

    def det(col: int | None) -> str:
        a = [[cell(i, j, col) for j in range(3)] for i in range(3)]
        minor = lambda p, q: f"({a[1][p]} * {a[2][q]} - {a[1][q]} * {a[2][p]})"
        return f"({a[0][0]} * {minor(1, 2)} - {a[0][1]} * {minor(0, 2)} + {a[0][2]} * {minor(0, 1)})"

    terms = " UNION ALL ".join(f"SELECT '{n}' AS term, round(b{i}, 2) AS coefficient FROM b" for i, n in enumerate(x))
    return (
        f"WITH m AS (SELECT {', '.join(sums)}, avg(l_extendedprice) AS my FROM lineitem), "
        f"b AS (SELECT *, {', '.join(f'{det(i)} / {det(None)} AS b{i}' for i in range(3))} FROM m) "
        f"{terms} UNION ALL SELECT 'intercept', round(my - b0 * m0 - b1 * m1 - b2 * m2, 2) FROM b"
    )


def _sparse_sql(first: float, second: float) -> str:
    """One coordinate step from quantity alone. The optimum is where every coordinate equals its soft-thresholded
    step, so the coefficients agree only if the others stay at zero against the same residual."""
    soft = lambda v: f"(sign({v}) * greatest(abs({v}) - {first}, 0))"
    rest = {n: f"{soft(f'c{n} - x{n} * bq')} / (v{n} + {second})" for n in "dt"}
    stats = ", ".join(f"covar_pop({c}, l_extendedprice) AS c{n}, var_pop({c}) AS v{n}, avg({c}) AS m{n}, covar_pop({c}, l_quantity) AS x{n}" for n, c in zip("qdt", ("l_quantity", "l_discount", "l_tax")))
    return (
        f"WITH m AS (SELECT {stats}, avg(l_extendedprice) AS my FROM lineitem), q AS (SELECT *, {soft('cq')} / (vq + {second}) AS bq FROM m), "
        f"b AS (SELECT *, {rest['d']} AS bd, {rest['t']} AS bt FROM q) SELECT 'l_quantity' AS term, round(bq, 2) AS coefficient FROM b "
        "UNION ALL SELECT 'l_discount', round(bd, 2) + 0.0 FROM b UNION ALL SELECT 'l_tax', round(bt, 2) + 0.0 FROM b "
        "UNION ALL SELECT 'intercept', round(my - bq * mq - bd * md - bt * mt, 2) FROM b"
    )


def _regress(algorithm: str, alpha: float):
    def run(spark, d):
        rows = V.table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label"))
        x = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(rows)
        n, sd = rows.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
        m = mllib.regressor(algorithm, alpha, n, sd).fit(x)
        names = ["intercept", "l_quantity", "l_discount", "l_tax"]
        values = [float(m.intercept), *[float(v) for v in m.coefficients]]
        return spark.createDataFrame([(n, round(v, 2) + 0.0) for n, v in zip(names, values)], "term string, coefficient double")

    return run


query("lasso", _sparse_sql(10.0, 0.0))(_regress("Lasso", 10.0))
query("ridge", _ridge_sql(10.0))(_regress("Ridge", 10.0))
query("elastic_net", _sparse_sql(5.0, 5.0))(_regress("ElasticNet", 10.0))
