"""Mixing sources to target weights by weighted fair queueing.

Targets: sources, by code point and NULL last, weigh 5, 2, 1, repeating, and share all
words; none gets more than ``cap`` times its size, and what is above goes to the others by
weight. Queue: each source's documents stand in a seeded hash order, pass after pass; a
document's finish time is the source's words up to and with it, divided by the source's
target. All copies are range-sorted by finish time and taken whole while the total
stays within the budget.

Nulls: a NULL text has size 0; a NULL source is a source; a NULL doc_id is shuffled like
any other value. Documents of size 0 are never taken. Repeated rows stand in the queue
each on its own. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfgrid.llm.common import load, query, table
from perfgrid.operators.ranking import prefix_sums
from perfgrid.session import broadcast_checked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def sized(docs: DataFrame, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """(_row, doc_id, source, size, _h): what the queue needs, without texts."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("_row", *keep, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.md5(key).alias("_h"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """One row a source: source, source_no, source_size, target (words)."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", F.row_number().over(by_name))
    w = F.array(*[F.lit(float(x)) for x in weights])[F.pmod(F.col("source_no") - 1, F.lit(len(weights)))]
    s = s.withColumn("_w", w).withColumn("_top", F.col("source_size") * cap).withColumn("_r", F.col("_top") / F.col("_w"))
    filled = Window.orderBy("_r", "source_no")
    s = s.withColumns(
        {
            "_all": F.sum("source_size").over(everything),
            "_below": F.coalesce(F.sum("_top").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_rest": F.sum("_w").over(filled.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    s = s.withColumn("_level", (F.col("_all") - F.col("_below")) / F.col("_rest"))
    s = s.withColumn("_level", F.min(F.when(F.col("_r") > F.col("_level"), F.struct("_r", "source_no", "_level"))).over(everything)["_level"])
    open_ = F.col("_r") > F.coalesce("_level", F.lit(0.0))
    target = F.when(F.col("_level").isNotNull() & open_, F.col("_w") * F.col("_level")).otherwise(F.col("_top").cast("double"))
    return s.select("source", "source_no", "source_size", target.alias("target"), F.col("_all").alias("budget"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """Adds source_size, target and copies (times the mix takes the document) to ``sizes``,
    which has to be a written table."""
    by_source = table(targets(sizes, weights, cap), "targets")
    live = sizes.filter("size > 0").withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull())
    queue = prefix_sums(live, ["_null", "_s"], ["_h", "doc_id", "size", "_row"], ["size"])
    same = F.col("q.source").eqNullSafe(F.col("t.source"))
    queue = queue.alias("q").join(by_source.alias("t"), same).select("q._row", "q.doc_id", "q._h", "q.size", "q.size_upto", "t.source_no", "t.source_size", "t.target", "t.budget")
    starts = F.col("size_upto") - F.col("size")
    passes = queue.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).filter(F.col("_pass") * F.col("source_size") + starts < F.col("target"))
    timed = passes.withColumn("finish", (F.col("_pass") * F.col("source_size") + F.col("size_upto")).cast("double") / F.col("target"))
    lined = prefix_sums(timed, [], ["finish", "source_no", "_pass", "_h", "doc_id", "_row"], ["size"], "_total")
    taken = lined.filter(F.col("size_total") <= F.col("budget")).groupBy("_row").agg(F.count(F.lit(1)).alias("copies"))
    out = sizes.alias("q").join(by_source.alias("t"), same).select("q.*", "t.source_size", "t.target")
    return out.join(taken, "_row", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """The documents that the mix takes, once for each time, with the columns they have."""

    def key(of: str):
        return F.xxhash64(F.col(f"{of}.doc_id").cast("long"), F.col(f"{of}.source").cast("string"), F.col(f"{of}.text").cast("string"))

    keyed = docs.alias("d").select("d.doc_id", "d.source", "d.text", key("d").alias("_key")).withColumn("_row", F.monotonically_increasing_id())
    sizes = table(sized(keyed, keep=("_key",)), "sizes")
    mixed = mix(sizes, weights, cap)
    taken = mixed.groupBy(F.col("doc_id").alias("_id"), "_key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).filter("copies > 0")
    taken = broadcast_checked(table(taken, "taken"), 56)
    same = (key("d") == F.col("k._key")) & F.col("d.doc_id").eqNullSafe(F.col("k._id"))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]

    def times(rows: DataFrame) -> DataFrame:
        out = rows.alias("d").join(taken.alias("k"), same).select(*columns, F.explode(F.sequence(F.lit(1), F.col("k.copies").cast("int"))).alias("__pass"))
        return out.drop("__pass")

    twice = taken.filter("n > 1")
    if twice.isEmpty():
        return times(docs)
    once = docs.alias("d").join(twice.alias("k"), same, "left_semi").dropDuplicates(["doc_id", "source", "text"])
    return times(docs.alias("d").join(twice.alias("k"), same, "left_anti").unionByName(once))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((no - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
r AS (SELECT *, (3 * source_size) / w AS r, (sum(source_size) OVER ())::BIGINT AS budget FROM w),
l AS (SELECT *, (budget - coalesce(sum(3 * source_size) OVER (ORDER BY r, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(w) OVER (ORDER BY r, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
m AS (SELECT (SELECT level FROM l WHERE r > level ORDER BY r, no LIMIT 1) AS level),
t AS (SELECT source, no, source_size, budget, CASE WHEN r > m.level THEN w * m.level ELSE (3 * source_size)::DOUBLE END AS target FROM l, m),
q AS (SELECT d.*, t.no, t.source_size, t.target, t.budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.*, e.pass, (pass * source_size + upto)::DOUBLE / target AS finish
      FROM q, (SELECT unnest([0, 1, 2]) AS pass) e WHERE size > 0 AND pass * source_size + upto - size < target),
k AS (SELECT *, sum(size) OVER (ORDER BY finish, no, pass, h, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM p),
g AS (SELECT doc_id, count(*) AS copies FROM k WHERE total <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(g.copies, 0))::BIGINT AS taken FROM q LEFT JOIN g USING (doc_id)
"""


@query("op1_fair_mix", SQL)
def fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("_row", F.monotonically_increasing_id())
    mixed = mix(table(sized(docs), "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
