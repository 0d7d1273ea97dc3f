"""MinHash near-duplicates with tensored banding and exact confirmation.

A document's set: hashes (64 bits) of its distinct word shingles. ``collections`` small bands
of two minhashes each are computed; a table key combines two of them, so m bands give
m (m - 1) / 2 tables for 2 m minhashes, and a pair shares a table unless fewer than two
bands agree. ``collections`` is the least number that misses a pair at the threshold with a
chance below ``miss``.

Documents with one set are one class. Bands met by one class only are dropped before keys are
formed. Each member of a bucket is compared with the bucket's leader, and what is linked is joined.
What is left, pairs that share a table and are in different components, is compared in
blocks: classes that buckets connect form a cluster, and tasks take two blocks of a cluster. No bucket
is capped and none is expanded into its pairs. Every link is confirmed on full sets.

Nulls: a NULL or wordless text has an empty set and is linked with nothing. A NULL doc_id takes
part; a component's id is its smallest doc_id. Repeated rows are copies. Fewer words than a
shingle: the whole sequence is the only shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfgrid.llm.common import Cache, enter, load, query, slices, table
from perfgrid.llm.components import components
from perfgrid.session import broadcast_checked

MISS = 1e-7
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_WORDS = Cache("near_dedup", xxhash.xxh64_intdigest)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; words are runs of anything but ASCII white space, with
    A-Z in lower case."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * _MIX[0] + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def collections_for(threshold: float, size: int = 2, miss: float = MISS) -> int:
    """Least number of bands of ``size`` minhashes of which two agree with a chance above 1 - miss."""
    p, m = threshold**size, 2
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > miss:
        m += 1
    return m


def band_keys(s: np.ndarray, bands: int, size: int = 2) -> np.ndarray:
    """One int64 for each band of ``size`` minhashes."""
    rng = np.random.default_rng(20)
    xor, odd = rng.integers(0, 2**64, (2, bands * size), np.uint64)
    odd |= np.uint64(1)
    low = np.empty(bands * size, np.uint64)
    low[:] = np.iinfo(np.uint64).max
    for a in range(0, len(s), 4096):
        v = (s[a : a + 4096, None] ^ xor) * odd
        v ^= v >> np.uint64(32)
        np.minimum(low, (v * odd).min(axis=0), out=low)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(size):
        key = mixed(key * _MIX[0] + low.reshape(bands, size)[:, i])
    return key.view(np.int64)


def near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |a & b| >= percent |a | b| for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def near_components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, _key); ``_key`` is xxhash64(doc_id, text)."""
    bands = collections_for(percent / 100)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("_key", F.xxhash64("doc_id", "text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_dedup")
        for batch in (part for whole in batches for part in slices(whole)):
            n, digest, keys = [], [], []
            for t in batch.column("text").to_pylist():
                s = shingle_set(t, words)
                n.append(len(s))
                digest.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(s, bands) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "_key", "n_shingles", "digest", "bands"])

    signed = keyed.mapInArrow(sign, "doc_id long, _key long, n_shingles long, digest binary, bands array<long>")
    signed = table(signed.withColumn("_row", F.monotonically_increasing_id()), "signatures")
    first = F.min_by(F.struct("_row", "doc_id", "_key", "bands", "n_shingles"), "_row").alias("c")
    classes = table(signed.filter("n_shingles > 0").groupBy("digest").agg(first).select("c.*", "digest").withColumnRenamed("_row", "rep"), "classes")

    band_rows = classes.select("rep", F.posexplode("bands").alias("band", "g"))
    shared = band_rows.groupBy("band", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = band_rows.join(shared, ["band", "g"])
    met = met.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("band", "g"))).alias("met")).filter(F.size("met") > 1)
    met = table(met.join(classes.select("rep", "doc_id", "_key", "n_shingles"), "rep"), "met")
    sets = _sets(keyed, met, words)

    later = F.expr("flatten(transform(met, (x, i) -> transform(slice(met, i + 2, size(met)), y -> struct(x.band * 1000 + y.band AS pair, xxhash64(x.g, y.g) AS g))))")
    tables = table(met.select("rep", F.explode(later).alias("t")).select("rep", F.xxhash64("t.pair", "t.g").alias("t")), "tables")
    lone = tables.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t")
    tables = table(tables.join(lone, "t"), "tables")
    leaders = tables.groupBy("t").agg(F.min("rep").alias("a"))
    pairs = table(tables.join(leaders, "t").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    links = _confirm(pairs, sets, percent)
    comp, cluster = table(components(links), "components"), components(pairs)
    known = met.select("rep", "met").join(cluster.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    known = known.join(comp.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    rest = _rest(table(known, "clusters"), sets, bands, percent)
    if not rest.isEmpty():  # they join whole components
        name = lambda c: F.coalesce(f"c{c}.component", f"r.{c}").alias(c)
        ends = rest.alias("r").join(comp.alias("ca"), F.col("r.a") == F.col("ca.node"), "left").join(comp.alias("cb"), F.col("r.b") == F.col("cb.node"), "left").select(name("a"), name("b"))
        ends = table(ends, "ends")
        upper = components(ends).select(F.col("node").alias("component"), F.col("component").alias("top"))
        lone = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct().join(comp, "node", "left_anti")
        comp = comp.unionByName(lone.withColumn("component", F.col("node"))).join(upper, "component", "left")
        comp = table(comp.select("node", F.coalesce("top", "component").alias("component")), "components")

    member = signed.select("_row", "doc_id", "_key", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest", "left")
    member = member.withColumn("node", F.coalesce("rep", "_row")).join(comp, "node", "left").withColumn("_c", F.coalesce("component", "node"))
    member = table(member.select("doc_id", "_key", "n_shingles", "_c"), "members")
    names = member.groupBy("_c").agg(F.min("doc_id").alias("component_id"))
    return member.join(names, "_c").select("doc_id", "n_shingles", "component_id", "_key", "_c")


def without_near(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Documents of which one of each group stays, that of the smallest doc_id; columns as they are.
    Wordless texts all stay."""
    groups = table(near_components(docs, words, percent), "groups")
    kept = groups.groupBy("_c").agg(F.min(F.struct("doc_id", "_key")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k._key").alias("_key")).distinct()
    key = F.xxhash64(F.col("d.doc_id").cast("long"), F.col("d.text").cast("string"))
    same = (key == F.col("k._key")) & F.col("d.doc_id").eqNullSafe(F.col("k._id"))
    left = docs.alias("d").join(broadcast_checked(table(kept, "kept"), 40).alias("k"), same, "left_semi")
    twice = table(groups.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("_id"), "_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
    if twice.isEmpty():
        return left
    hint = broadcast_checked(twice, 40).alias("k")  # rows given several times are one document
    return left.alias("d").join(hint, same, "left_anti").unionByName(left.alias("d").join(hint, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def _sets(keyed: DataFrame, met: DataFrame, words: int) -> DataFrame:
    """(rep, set) of the classes whose bands meet another's, from their texts."""
    wanted = broadcast_checked(met.select("rep", F.col("doc_id").alias("_id"), "_key"), 40)
    found = keyed.join(wanted, "_key").filter(F.col("doc_id").eqNullSafe(F.col("_id"))).select("rep", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_dedup")
        for batch in (part for whole in batches for part in slices(whole)):
            sets = [shingle_set(t, words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], ["rep", "set"])

    return table(found.mapInArrow(build, "rep long, set binary").dropDuplicates(["rep"]), "sets")


def _rest(known: DataFrame, sets: DataFrame, bands: int, percent: int, rows: int = 512, size: int = 8 << 20) -> DataFrame:
    """Links (a, b) between different components of a cluster. A cluster is dealt to blocks of about
    ``rows`` sets or ``size`` bytes; a task has two blocks and looks at the pairs that share a table."""
    open_ = known.groupBy("cluster").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("cluster")
    some = table(known.join(open_, "cluster").join(sets, "rep"), "open")
    n = F.ceil(F.greatest(F.count(F.lit(1)) / rows, F.sum(F.length("set")) / size)).cast("int").alias("blocks")
    blocks = table(some.groupBy("cluster").agg(n, F.count(F.lit(1)).alias("n")), "blocks")
    dealt = some.join(blocks.drop("n"), "cluster").withColumn("_b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select("cluster", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), "_b", "rep", "c", "met", "set")
    dealt_rows = blocks.agg(F.sum(F.col("blocks") * F.col("n"))).first()[0] or 1

    def tile(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        rep, comp, block = (t.column(k).to_numpy() for k in ("rep", "c", "_b"))
        found = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        band, here = np.zeros((len(rep), bands), np.int64), np.zeros((len(rep), bands), bool)
        for k, m in enumerate(t.column("met").to_pylist()):
            for x in m:
                band[k, x["band"]], here[k, x["band"]] = x["g"], True
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        length = np.array([len(x) for x in found])
        joined: dict[int, int] = {}

        def top(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        out = []
        for at in range(0, len(left), 64):
            u = left[at : at + 64]
            agree = np.zeros((len(u), len(right)), np.int16)
            for k in range(bands):
                agree += (band[u, k][:, None] == band[right, k]) & here[u, k][:, None] & here[right, k]
            low, high = np.minimum(length[u][:, None], length[right]), np.maximum(length[u][:, None], length[right])
            open_pairs = (agree > 1) & (comp[u][:, None] != comp[right]) & (100 * low >= percent * high)
            if i == j:
                open_pairs &= u[:, None] < right
            for x, y in zip(*np.nonzero(open_pairs)):
                p, q = u[x], right[y]
                cp, cq = top(int(comp[p])), top(int(comp[q]))
                if cp != cq and near(found[p], found[q], percent):
                    joined[cp] = cq
                    out.append((int(rep[p]), int(rep[q])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    tiles = tiles.repartition(min(-(-dealt_rows // rows), 100_000), "cluster", "i", "j")
    return table(tiles.groupBy("cluster", "i", "j").applyInArrow(tile, "a long, b long"), "links")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, group: int = 512) -> DataFrame:
    """Pairs (a, b) whose full sets are near. Pairs are grouped by ``a``, at most about ``group`` in
    a task's group, so the set of ``a`` is sent once for each and that of ``b`` once a pair."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("n"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("salt"))
    right = dealt.join(sets.withColumnRenamed("rep", "b"), "b")
    left = many.join(sets.withColumnRenamed("rep", "a"), "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    left = left.select(F.col("a").alias("ka"), F.col("salt").alias("ks"), F.col("set").alias("sa"))

    def check(one: pa.Table, others: pa.Table) -> pa.Table:
        b = others.column("b").to_pylist()
        if one.num_rows == 0:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        s = np.frombuffer(one.column("sa")[0].as_py(), np.uint64)
        good = [x for x, y in zip(b, others.column("set")) if near(s, np.frombuffer(y.as_py(), np.uint64), percent)]
        return pa.table({"a": pa.array([one.column("ka")[0].as_py()] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    both = left.groupBy("ka", "ks").cogroup(right.groupBy("a", "salt")).applyInArrow(check, "a long, b long")
    return table(both, "links")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS h FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i.a, i.b FROM i JOIN s sa ON sa.doc_id = i.a JOIN s sb ON sb.doc_id = i.b WHERE 100 * n >= 85 * (len(sa.s) + len(sb.s) - n)),
c AS (SELECT doc_id AS n, doc_id AS m FROM documents UNION SELECT l.b, c.m FROM c JOIN l ON c.n = l.a),
g AS (SELECT n, min(m) AS component_id FROM c GROUP BY n)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, g.component_id, s.doc_id = g.component_id AS kept FROM s JOIN g ON g.n = s.doc_id
"""


@query("op4_tensor_minhash", SQL)
def tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(load(spark, sf_dir, "documents"), 3, 85)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
