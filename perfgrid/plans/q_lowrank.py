"""Registered queries: low rank, tensors, design, cost models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from perfgrid.functions.scalars import r6
from perfgrid.operators import cost as K
from perfgrid.operators import design as D
from perfgrid.operators import lowrank as L
from perfgrid.operators import select as S
from perfgrid.operators import tucker as T
from perfgrid.operators.ranking import with_constants
from perfgrid.plans import views as V
from perfgrid.plans.q_tables import scratch
from perfgrid.plans.registry import query
from perfgrid.session import cut
from perfgrid.sources.tables import artefact

EMBL = V.ctes(V.EMB, V.EMB_LONG)


@query(
    "gram",
    EMBL + "SELECT CAST(a.j AS INT) AS i, CAST(b.j AS INT) AS j, round(sum(a.v * b.v), 6) + 0.0 AS value FROM embl a JOIN embl b ON a.row_id = b.row_id AND a.j <= b.j GROUP BY 1, 2",
)
def gram(spark, d):
    return L.gram(V.emb(spark, d), 64).withColumn("value", r6("value"))


def _factors(spark, d, **kw):
    return L.factorize(cut(V.perf(spark, d)), "dataset_id", "config_id", "error", **kw)


@query(
    "pca_ortho",
    """SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y_product
FROM (SELECT unnest(range(5)) AS i) a, (SELECT unnest(range(5)) AS j) b WHERE i <= j""",
)
def pca_ortho(spark, d):
    """Products of the config factors: the identity."""
    f = _factors(spark, d, rank=5)
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(F.col("y")[i] * F.col("y")[j]).alias("v")) for i in range(5) for j in range(i, 5)]
    t = f.cols.groupBy().agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("p"))
    return t.select("p.i", "p.j", r6("p.v").alias("y_product"))


@query("pca_recon", V.ctes(V.PERF) + "SELECT dataset_id, config_id, error, true AS equal FROM perf")
def pca_recon(spark, d):
    """At full rank the factors give the table back."""
    f = _factors(spark, d, rank=25)
    back = L.reconstruct(f, "dataset_id", "config_id").select("dataset_id", "config_id", "value")
    t = V.perf(spark, d).join(back, ["dataset_id", "config_id"], "left")
    return t.select("dataset_id", "config_id", "error", F.coalesce(F.abs(F.col("value") - F.col("error")) < 1e-9, F.lit(False)).alias("equal"))


@query("approx_rank", V.ctes(V.PERF) + "SELECT round(sum(error * error), 6) AS energy, true AS descending, true AS rank_grows FROM perf")
def approx_rank(spark, d):
    """Squared singular values sum to the table's energy; a lower threshold never lowers the rank."""
    s = _factors(spark, d, rank=25).all_sigma
    r = [L.approx_rank(s, t) for t in (0.5, 0.1, 0.03, 0.01)]
    row = (round(float((s**2).sum()), 6), bool((np.diff(s) <= 1e-12).all()), bool((np.diff(r) >= 0).all() and r[0] >= 1))
    return spark.createDataFrame([row], "energy double, descending boolean, rank_grows boolean")


@query(
    "tensor_rank",
    V.ctes(V.TENSOR) + "SELECT round(sum(value * value), 6) AS energy, CAST(6 AS INT) AS r2, CAST(3 AS INT) AS r3, CAST(2 AS INT) AS r4, true AS within FROM tensor",
)
def tensor_rank(spark, d):
    t = V.tensor(spark, d)
    g = T.mode_moment(t, 0, V.TENSOR_SIZES)
    r = T.tensor_rank(t, V.TENSOR_SIZES, [0, 1], 0.05)
    within = bool(1 <= r[0] <= 25 and 1 <= r[1] <= 25)
    row = (round(float(np.trace(g)), 6), r[2], r[3], r[4], within)
    return spark.createDataFrame([row], "energy double, r2 int, r3 int, r4 int, within boolean")


@query("unfold", V.ctes(V.TENSOR) + "SELECT i2, CAST(((i0 * 25 + i1) * 3 + i3) * 2 + i4 AS BIGINT) AS j, round(value, 6) AS value FROM tensor")
def unfold(spark, d):
    return T.unfold(V.tensor(spark, d), 2, V.TENSOR_SIZES).withColumn("value", r6("value"))


@query(
    "mode_product",
    V.ctes(V.TENSOR, V.PERF)
    + """, m AS (SELECT dataset_id AS i, avg(error) AS w0, avg(runtime) / 10 AS w1 FROM perf GROUP BY 1)
SELECT CAST(r AS INT) AS i0, i1, i2, i3, i4, round(sum(value * CASE WHEN r = 0 THEN w0 ELSE w1 END), 6) AS value
FROM tensor JOIN m ON i0 = i, (SELECT unnest([0, 1]) AS r) GROUP BY 1, 2, 3, 4, 5""",
)
def mode_product(spark, d):
    m = V.perf(spark, d).groupBy(F.col("dataset_id").alias("i")).agg(F.array(F.avg("error"), F.avg("runtime") / 10).alias("w"))
    return T.mode_product(V.tensor(spark, d), 0, m, 2, 5).withColumn("value", r6("value"))


@query("tucker_factors", V.ctes(V.TENSOR) + "SELECT i0, i1, i2, i3, i4, round(value, 5) AS value, true AS ortho FROM tensor")
def tucker_factors(spark, d):
    """At full ranks the decomposition gives every observed cell back."""
    t = V.tensor(spark, d)
    full = T.decompose(t, V.TENSOR_SIZES, V.TENSOR_SIZES, sweeps=1)
    low = T.decompose(t, V.TENSOR_SIZES, [4, 4, 3, 2, 2], sweeps=1)
    ortho = all(np.allclose(u.T @ u, np.eye(u.shape[1]), atol=1e-6) for u in low.factors)

    def cells(batches):
        for b in batches:
            b["value"] = T.predict_cells(full, [b[f"i{m}"].to_numpy() for m in range(5)])
            yield b

    out = t.mapInPandas(cells, "i0 int, i1 int, i2 int, i3 int, i4 int, value double")
    return out.withColumn("value", F.round("value", 5) + 0.0).withColumn("ortho", F.lit(ortho))


RANKS = [3, 3, 2, 2, 2]


@query("complete_observed_kept", V.ctes(V.TENSOR) + "SELECT i0, i1, i2, i3, i4, round(value, 6) AS value FROM tensor")
def complete_observed_kept(spark, d):
    """Completed table restricted to its observed cells: unchanged."""
    t = V.tensor(spark, d)
    model = T.complete(t, V.TENSOR_SIZES, RANKS)
    return T.fill(t, V.TENSOR_SIZES, model).filter("observed").drop("observed").withColumn("value", r6("value"))


@query("complete_error_monotone", V.ctes(V.TENSOR) + ", s AS (SELECT CAST(unnest(range(1, 5)) AS INT) AS sweep) SELECT sweep, true AS ok, count(*) AS n_cells FROM s, tensor GROUP BY 1, 2")
def complete_error_monotone(spark, d):
    """The observed error never rises from sweep to sweep."""
    t = V.tensor(spark, d)
    e = T.complete(t, V.TENSOR_SIZES, RANKS, max_sweeps=4, tolerance=-1.0).errors
    rows = [(i + 1, bool(i == 0 or e[i] <= e[i - 1] + 1e-9)) for i in range(len(e))]
    n = t.groupBy().agg(F.count(F.lit(1)).alias("n_cells"))
    return with_constants(spark.createDataFrame(rows, "sweep int, ok boolean"), n)


_AXES = ", ".join(f"p{i} AS (SELECT i{i}, 20 * avg(value) AS a, (count(*) % {m} - {(m - 1) / 2}) AS b FROM tensor GROUP BY 1)" for i, m in ((0, 5), (1, 4), (2, 3)))
PLANTED = f"""{_AXES},
pl AS (SELECT i0, i1, i2, p0.a * p1.a * p2.a + p0.b * p1.b * p2.b AS value, substr(md5(concat_ws('|', i0, i1, i2)), 1, 1) < '4' AS hidden FROM p0, p1, p2)"""


def planted(spark, d):
    """A table of rank two made from averages and counts of the data: (i0, i1, i2, value)."""
    t, parts = V.tensor(spark, d), None
    for i, m in ((0, 5), (1, 4), (2, 3)):
        axis = t.groupBy(f"i{i}").agg((20 * F.avg("value")).alias(f"a{i}"), (F.count(F.lit(1)) % m - (m - 1) / 2).alias(f"b{i}"))
        parts = axis if parts is None else parts.crossJoin(F.broadcast(axis))  # one row for each nation, brand and type
    return cut(parts.select("i0", "i1", "i2", (F.col("a0") * F.col("a1") * F.col("a2") + F.col("b0") * F.col("b1") * F.col("b2")).alias("value")))


@query("hidden_cells", V.ctes(V.TENSOR, PLANTED) + "SELECT i0, count(*) AS n_hidden, true AS near, round(sum(value), 4) AS total FROM pl WHERE hidden GROUP BY 1")
def hidden_cells(spark, d):
    """A table of rank two made from averages of the data, a quarter of it hidden: completion run to its own
    stop rule finds the hidden cells of every nation to within a hundredth of their norm."""
    hidden = F.substring(F.md5(F.concat_ws("|", "i0", "i1", "i2")), 1, 1) < "4"
    whole = planted(spark, d).withColumn("hidden", hidden)
    sizes = V.TENSOR_SIZES[:3]
    model = T.complete(whole.filter("NOT hidden").drop("hidden"), sizes, [2, 2, 2], mean_fill=True)
    found = T.fill(whole.filter("NOT hidden").drop("hidden"), sizes, model).filter("NOT observed").select("i0", "i1", "i2", F.col("value").alias("model"))
    out = whole.filter("hidden").join(found, ["i0", "i1", "i2"])
    gap = F.col("model") - F.col("value")
    near = F.sum(gap * gap) < 1e-4 * F.sum(F.col("value") * F.col("value"))
    return out.groupBy("i0").agg(F.count(F.lit(1)).alias("n_hidden"), near.alias("near"), F.round(F.sum("value"), 4).alias("total"))


@query("latent_factors", """SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CASE WHEN i = j THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS product, CAST(900 AS BIGINT) AS n_configs
FROM (SELECT unnest(range(3)) AS i) a, (SELECT unnest(range(3)) AS j) b WHERE i <= j""")
def latent_factors(spark, d):
    """Latent configuration factors of the completed tensor are orthonormal."""
    t = V.tensor(spark, d)
    model = T.complete(t, V.TENSOR_SIZES, [4, 4, 3, 2, 2])
    _, cols = T.latent_configs(spark, model, V.TENSOR_SIZES, 3)
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(F.col("y")[i] * F.col("y")[j]).alias("v")) for i in range(3) for j in range(i, 3)]
    g = cols.groupBy().agg(F.array(*pairs).alias("p"), F.count(F.lit(1)).alias("n_configs")).select(F.explode("p").alias("p"), "n_configs")
    return g.select("p.i", "p.j", r6("p.v").alias("product"), "n_configs")


BIG_HOLES = "obs AS (SELECT dataset_id, config_id, error FROM perf_big WHERE runtime <= 26.5), col AS (SELECT config_id, avg(error) AS y FROM perf GROUP BY 1)"


@query(
    "complete_row_rank1",
    V.ctes(V.PERF, V.PERF_BIG, BIG_HOLES)
    + """, x AS (SELECT dataset_id, sum(error * y) / sum(y * y) AS x FROM obs JOIN col USING (config_id) GROUP BY 1)
SELECT dataset_id, config_id, round(x * y, 6) AS predicted FROM x, col""",
)
def complete_row_rank1(spark, d):
    """All new rows completed at once with one given latent column per config."""
    cols = V.perf(spark, d).groupBy("config_id").agg(F.array(F.avg("error")).alias("y"))
    obs = V.perf_big(spark, d).filter(F.col("runtime") <= V.TIMEOUT)
    return L.complete_rows(obs, cols, 1).withColumn("predicted", r6("predicted"))


@query(
    "complete_rows",
    V.ctes(V.PERF_BIG)
    + "SELECT dataset_id, CAST(0 AS DOUBLE) AS worst_residual, CAST(25 AS BIGINT) AS n_cells FROM perf_big WHERE runtime <= 26.5 GROUP BY 1",
)
def complete_rows(spark, d):
    """Rank-3 completion: what is left of each known row is orthogonal to the latent columns."""
    f = _factors(spark, d, rank=3)
    obs = V.perf_big(spark, d).filter(F.col("runtime") <= V.TIMEOUT)
    done = L.complete_rows(obs, f.cols, 3)
    gap = done.join(obs.select("dataset_id", "config_id", "error"), ["dataset_id", "config_id"], "left").join(f.cols, "config_id")
    left = [F.abs(F.sum((F.col("error") - F.col("predicted")) * F.col("y")[r])) for r in range(3)]
    return gap.groupBy("dataset_id").agg(r6(F.greatest(*left)).alias("worst_residual"), F.count("predicted").alias("n_cells"))


@query(
    "pca_reduce",
    EMBL + ", c AS (SELECT j, avg(v) AS m FROM embl GROUP BY 1) SELECT row_id, round(sum((v - m) * (v - m)), 6) AS energy FROM embl JOIN c USING (j) GROUP BY 1",
)
def pca_reduce(spark, d):
    """A quarter of the components: scores and remainder add up to each row's energy."""
    t, _, _ = L.pca_scores(V.emb(spark, d), "x", 16)
    energy = F.aggregate("score", F.lit(0.0), lambda s, v: s + v * v) + F.col("rest")
    return t.select("row_id", r6(energy).alias("energy"))


PIVOT = """n AS (SELECT config_id, sum(error * error) AS s FROM perf_big GROUP BY 1),
p1 AS (SELECT config_id AS c, s AS ss FROM n ORDER BY s DESC, config_id LIMIT 1),
g AS (SELECT b.config_id, sum(a.error * b.error) AS g FROM perf_big a JOIN p1 ON a.config_id = c JOIN perf_big b USING (dataset_id) GROUP BY 1)"""


@query("pivot_first", V.ctes(V.PERF_BIG, PIVOT) + "SELECT c AS config_id, round(ss, 6) AS energy FROM p1")
def pivot_first(spark, d):
    p = cut(V.perf_big(spark, d))
    first = L.pivot_columns(p, "dataset_id", "config_id", "error", rank=1)
    energy = p.groupBy("config_id").agg(r6(F.sum(F.col("error") * F.col("error"))).alias("energy"))
    return energy.join(first.select("config_id"), "config_id", "left_semi")


@query(
    "pivot_columns",
    V.ctes(V.PERF_BIG, PIVOT)
    + """, p2 AS (SELECT config_id FROM n JOIN g USING (config_id), p1 WHERE config_id <> c ORDER BY s - g * g / ss DESC, config_id LIMIT 1)
SELECT CAST(1 AS BIGINT) AS place, c AS config_id FROM p1 UNION ALL SELECT 2, config_id FROM p2""",
)
def pivot_columns(spark, d):
    return L.pivot_columns(V.perf_big(spark, d), "dataset_id", "config_id", "error", rank=2)


@query(
    "pivot_budgeted",
    V.ctes(V.PERF) + ", b AS (SELECT dataset_id, 180.0 AS budget FROM perf GROUP BY 1) SELECT dataset_id, true AS within, true AS distinct_picks, true AS enough FROM b",
)
def pivot_budgeted(spark, d):
    """Pivot picks per dataset: within budget, no repeats, as many as the rank."""
    p = V.perf(spark, d)
    f = _factors(spark, d, rank=3)
    budgets = p.select("dataset_id").distinct().withColumn("budget", F.lit(180.0))
    t = D.select(p, f.cols, budgets, 3, extend=False)
    n = F.count(F.lit(1))
    enough = F.when(F.max("case") == "pivot", n == 3).otherwise(n >= 1)
    return t.groupBy("dataset_id").agg((F.max("spent") <= 180.0).alias("within"), (F.count_distinct("config_id") == n).alias("distinct_picks"), enough.alias("enough"))


@query(
    "doptimal_first",
    V.ctes(V.PERF, V.PERF_BIG)
    + """, col AS (SELECT config_id, avg(error) AS y FROM perf GROUP BY 1), t AS (SELECT dataset_id, config_id, runtime, y FROM perf_big JOIN col USING (config_id)),
p AS (SELECT * FROM t WHERE runtime <= 100 / 2.0 QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY y * y DESC, config_id) = 1),
q AS (SELECT t.*, p.config_id AS pc, p.runtime AS pt FROM t JOIN p USING (dataset_id) WHERE t.config_id <> p.config_id AND p.runtime + t.runtime <= 100
  QUALIFY row_number() OVER (PARTITION BY t.dataset_id ORDER BY t.y * t.y / t.runtime DESC, t.config_id) = 1)
SELECT dataset_id, pc AS first_pick, config_id AS second_pick, round(pt + runtime, 6) AS spent FROM q""",
)
def doptimal_first(spark, d):
    """One latent column: the pivot pick and the first pick by information per cost."""
    cols = V.perf(spark, d).groupBy("config_id").agg(F.array(F.avg("error")).alias("y"))
    p = cut(V.perf_big(spark, d))
    budgets = p.select("dataset_id").distinct().withColumn("budget", F.lit(100.0))
    t = D.select(p, cols, budgets, 1)
    at = lambda c, i: F.max(F.when(F.col("place") == i, F.col(c)))
    return t.groupBy("dataset_id").agg(at("config_id", 1).alias("first_pick"), at("config_id", 2).alias("second_pick"), r6(at("spent", 2)).alias("spent"))


@query("doptimal", V.ctes(V.PERF_BIG) + "SELECT dataset_id, true AS within, true AS distinct_picks, true AS full FROM perf_big GROUP BY 1")
def doptimal(spark, d):
    """Greedy D-optimal designs of all suppliers: within budget and nothing more fits."""
    f = _factors(spark, d, rank=3)
    p = cut(V.perf_big(spark, d))
    budgets = p.select("dataset_id").distinct().withColumn("budget", F.lit(200.0))
    t = D.select(p, f.cols, budgets, 3).groupBy("dataset_id").agg(
        F.max("spent").alias("spent"), F.count(F.lit(1)).alias("n"), F.count_distinct("config_id").alias("u"), F.collect_set("config_id").alias("ids")
    )
    rest = p.join(t, "dataset_id").filter(~F.array_contains("ids", F.col("config_id"))).groupBy("dataset_id").agg(F.min("runtime").alias("least"))
    t = t.join(rest, "dataset_id", "left")
    return t.select(
        "dataset_id", (F.col("spent") <= 200).alias("within"), (F.col("n") == F.col("u")).alias("distinct_picks"),
        (F.coalesce("least", F.lit(1e9)) + F.col("spent") > 200).alias("full"),
    )


@query(
    "design_criteria",
    V.ctes(V.PERF)
    + """, col AS (SELECT config_id, avg(error) AS y0, avg(runtime) / 100 AS y1 FROM perf GROUP BY 1),
s AS (SELECT dataset_id, sum(y0 * y0) AS a, sum(y0 * y1) AS b, sum(y1 * y1) AS c FROM perf JOIN col USING (config_id) WHERE runtime <= 26.5 GROUP BY 1)
SELECT dataset_id, round(ln(a * c - b * b), 4) AS d, round((a + c) / (a * c - b * b) / 1000, 4) AS a,
 round(1 / ((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b)) / 1000, 4) AS e FROM s""",
)
def design_criteria(spark, d):
    p = V.perf(spark, d)
    cols = p.groupBy("config_id").agg(F.array(F.avg("error"), F.avg("runtime") / 100).alias("y"))
    t = D.criteria(p.filter(F.col("runtime") <= V.TIMEOUT).select("dataset_id", "config_id"), cols, 2)
    r4 = lambda c, s: F.round(F.col(c) / s, 4).alias(c)
    return t.select("dataset_id", r4("d", 1), r4("a", 1000), r4("e", 1000))


@query(
    "budget_pick",
    "WITH RECURSIVE "
    + V.PERF_BIG
    + """, o AS (SELECT dataset_id, config_id, runtime AS cost, row_number() OVER (PARTITION BY dataset_id ORDER BY error, config_id) AS r FROM perf_big),
w AS (SELECT dataset_id, CAST(0 AS BIGINT) AS r, CAST(0 AS DOUBLE) AS spent, CAST(NULL AS INT) AS config_id, false AS ok FROM o GROUP BY 1
 UNION ALL SELECT o.dataset_id, o.r, CASE WHEN w.spent + o.cost <= 120 THEN w.spent + o.cost ELSE w.spent END, o.config_id, w.spent + o.cost <= 120
 FROM w JOIN o ON o.dataset_id = w.dataset_id AND o.r = w.r + 1)
SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY r) AS place, config_id, round(spent, 6) AS spent FROM w WHERE ok""",
)
def budget_pick(spark, d):
    p = V.perf_big(spark, d).withColumnRenamed("runtime", "cost")
    return S.budget_pick(p, F.lit(120.0), ["error"]).withColumn("spent", r6("spent"))


@query(
    "random_affordable",
    V.ctes(V.PERF)
    + """, m AS (SELECT dataset_id, config_id FROM perf WHERE error <= 0.3), a AS (SELECT dataset_id, config_id FROM perf ANTI JOIN m USING (dataset_id, config_id) WHERE runtime <= 25),
c AS (SELECT dataset_id, config_id FROM a QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY md5(concat_ws('|', '0', dataset_id, config_id)), config_id) <= 2),
f AS (SELECT dataset_id, config_id FROM perf QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY runtime, config_id) = 1)
SELECT * FROM c UNION ALL SELECT * FROM f ANTI JOIN c USING (dataset_id)""",
)
def random_affordable(spark, d):
    p = V.perf(spark, d)
    return S.random_affordable(p, p.filter("error <= 0.3"), F.lit(25.0), 2)


RUNS = V.ctes(V.PERF, V.SIZES) + """, runs AS (SELECT dataset_id, config_id, runtime, n_rows, n_features FROM perf JOIN sizes USING (dataset_id)),
fit AS (SELECT config_id, regr_slope(ln(runtime), ln(n_rows)) AS slope, regr_intercept(ln(runtime), ln(n_rows)) AS intercept FROM runs GROUP BY 1) """


def _runs(spark, d):
    return V.perf(spark, d).join(V.sizes(spark, d), "dataset_id")


@query("cost_fit_1d", RUNS + "SELECT config_id, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM fit")
def cost_fit_1d(spark, d):
    t = K.fit_line(_runs(spark, d))
    return t.select("config_id", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("cost_predict_1d", RUNS + "SELECT dataset_id, config_id, round(exp(intercept + slope * ln(n_rows)), 5) AS runtime FROM fit, sizes")
def cost_predict_1d(spark, d):
    t = K.predict_line(K.fit_line(_runs(spark, d)), V.sizes(spark, d))
    return t.select("dataset_id", "config_id", F.round("runtime", 5).alias("runtime"))


@query(
    "cost_knn",
    RUNS
    + """, q AS (SELECT p.p_type, count(*) AS qn, count(DISTINCT l_suppkey) AS qm FROM lineitem JOIN part p ON l_partkey = p_partkey GROUP BY 1),
g AS (SELECT p_type, config_id, (CAST(n_rows AS DOUBLE) - qn) * (CAST(n_rows AS DOUBLE) - qn) + 100.0 * (n_features - qm) * (n_features - qm) AS g, ln(runtime) AS y FROM runs, q),
k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY p_type, config_id ORDER BY g, y) <= 5)
SELECT p_type AS dataset_id, config_id, round(exp(CASE WHEN sum(g) > 0 THEN sum(g * y) / sum(g) ELSE avg(y) END), 6) AS runtime FROM k GROUP BY 1, 2""",
)
def cost_knn(spark, d):
    """Costs of new datasets (all rows of a part type) from the five runs of nearest shape."""
    new = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    new = new.groupBy(F.col("p_type").alias("dataset_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_suppkey").alias("n_features"))
    return K.knn_cost(_runs(spark, d), new).withColumn("runtime", r6("runtime"))


@query("cost_fit", V.ctes(V.PERF_BIG, "one AS (SELECT config_id, count(*) AS n FROM perf_big GROUP BY 1)") + "SELECT config_id, n, CAST(0 AS DOUBLE) AS mean_residual FROM one")
def cost_fit(spark, d):
    """Twenty-term cost model: with a free constant its residuals average to zero per config."""
    li = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count_distinct("l_quantity") + F.count_distinct("l_discount")).alias("n_features")
    )
    runs = V.perf_big(spark, d).join(li, "dataset_id")
    got = K.predict_poly(K.fit_poly(runs), li).withColumnRenamed("runtime", "guess")
    t = runs.join(got, ["dataset_id", "config_id"]).groupBy("config_id")
    return t.agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg(F.log("runtime") - F.log("guess")), 4) + 0.0).alias("mean_residual"))


@query("warm_equals_fresh", V.ctes(V.PERF) + "SELECT config_id, count(*) AS n_equal, round(avg(error), 6) AS mean_error FROM perf GROUP BY 1")
def warm_equals_fresh(spark, d):
    """A stored performance table read back (warm) equals a rebuilt one (fresh)."""
    path = scratch(spark, "perf")
    build = lambda: V.perf(spark, d)
    fresh = artefact(spark, path, build, "fresh")
    warm = artefact(spark, path, build, "warm").withColumnRenamed("error", "warm_error")
    both = fresh.join(warm.select("dataset_id", "config_id", "warm_error"), ["dataset_id", "config_id"])
    return both.groupBy("config_id").agg(F.count(F.when(F.col("error") == F.col("warm_error"), 1)).alias("n_equal"), r6(F.avg("warm_error")).alias("mean_error"))


@query("planted_ranks", "SELECT CAST(unnest([2, 2, 2, 2]) AS INT) AS rank, unnest(['matrix', 'mode0', 'mode1', 'mode2']) AS of_")
def planted_ranks(spark, d):
    """Tables of rank two made from averages of the data: the matrix and every mode of the tensor have rank two."""
    whole = planted(spark, d)
    sigma = L.factorize(whole.filter("i2 = 0"), "i0", "i1", "value", rank=25).all_sigma
    ranks = [L.approx_rank(sigma, 1e-6), *T.tensor_rank(whole, V.TENSOR_SIZES[:3], [0, 1, 2], 1e-6)]
    return spark.createDataFrame(list(zip(map(int, ranks), ["matrix", "mode0", "mode1", "mode2"])), "rank int, of_ string")


THREE = """col AS (SELECT config_id, avg(error) AS y0, avg(runtime) / 100 AS y1 FROM perf GROUP BY 1),
t AS (SELECT dataset_id, config_id, runtime, y0, y1 FROM perf_big JOIN col USING (config_id) WHERE runtime <= 200),
p AS (SELECT * FROM t WHERE runtime <= 50 QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY round(y0 * y0 + y1 * y1, 12) DESC, config_id) = 1),
q AS (SELECT t.* FROM t JOIN p USING (dataset_id) WHERE t.runtime <= 50 AND t.config_id <> p.config_id
  QUALIFY row_number() OVER (PARTITION BY t.dataset_id ORDER BY t.y0 * t.y0 + t.y1 * t.y1 - (t.y0 * p.y0 + t.y1 * p.y1) ** 2 / (p.y0 * p.y0 + p.y1 * p.y1) DESC, t.config_id) = 1),
x AS (SELECT p.dataset_id, p.config_id AS first_pick, q.config_id AS second_pick, p.runtime + q.runtime AS spent,
  p.y0 * p.y0 + q.y0 * q.y0 AS a, p.y0 * p.y1 + q.y0 * q.y1 AS b, p.y1 * p.y1 + q.y1 * q.y1 AS c FROM p JOIN q USING (dataset_id)),
r AS (SELECT t.dataset_id, config_id, runtime, x.* EXCLUDE (dataset_id) FROM t JOIN x USING (dataset_id) WHERE config_id <> first_pick AND config_id <> second_pick AND spent + runtime <= 200
  QUALIFY row_number() OVER (PARTITION BY t.dataset_id ORDER BY (c * y0 * y0 - 2 * b * y0 * y1 + a * y1 * y1) / (a * c - b * b) / runtime DESC, config_id) = 1)"""


@query("doptimal_three", V.ctes(V.PERF, V.PERF_BIG, THREE) + "SELECT dataset_id, first_pick, second_pick, config_id AS third_pick, round(spent + runtime, 6) AS spent FROM r")
def doptimal_three(spark, d):
    """Two latent columns: both pivot picks and the first pick by information per cost, for every supplier."""
    cols = V.perf(spark, d).groupBy("config_id").agg(F.array(F.avg("error"), F.avg("runtime") / 100).alias("y"))
    p = cut(V.perf_big(spark, d))
    budgets = p.select("dataset_id").distinct().withColumn("budget", F.lit(200.0))
    at = lambda c, i: F.max(F.when(F.col("place") == i, F.col(c)))
    t = D.select(p, cols, budgets, 2).filter("case = 'pivot'").groupBy("dataset_id")
    t = t.agg(*[at("config_id", i).alias(f"{n}_pick") for i, n in ((1, "first"), (2, "second"), (3, "third"))], r6(at("spent", 3)).alias("spent"))
    return t.filter("third_pick IS NOT NULL")
