"""Toxicity of texts restored from leetspeak, spacing and repetition.

A word with symbols or digits inside, or with a letter three times running, is read as the output
of a noisy channel: each character offers itself, the letters it can stand for, or nothing (a
separator or a repeated letter). Viterbi decoding under a character trigram model, counted on the
words of all documents, gives the restored word; runs of single letters are joined first.
Other words have one reading only and are left as they are. Tokens of any length are decoded, in
time linear in their length, whole and between separators; of a spelled-out run every part of 4 to 12
letters is read (longer words are known by their beginnings). Letters beyond U+024F share one
class of the character model with the word's edge.

Words and word beginnings of restored texts are weighed by how much more often toxic documents
hold them; a logistic curve over a document's strongest piece of evidence, and to a lesser degree
over the next two, gives its score: a modelling choice, as one insult is enough. Both are learned
from one bounded sample of labelled rows (``train_rows`` of each label, by hash order) by leaving
one out: the curve sees each row with the weights that the other rows give. At most ``kept`` weights are
used, the greatest first. Nothing is learned from doc_id, lang, source or held-out rows.

Nulls: a NULL or empty text is scored as a text without evidence; a NULL doc_id is scored and not
held out; NULL labels are not learned from. Repeated rows are scored each. Without labels of
both kinds all scores are 0. An empty table gives no rows. Other columns stay; a column named
``score`` is replaced by ``scored`` and kept by ``without_toxic``.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from perfgrid.llm.common import Cache, at_leaving, enter, load, query, slices, table

LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
SIZE = 64
_EDGE = ".,;:!?\"'()[]{}<>|%&*#$@+=~_-/\\^`"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = re.compile(r"[_\-./\\,;:|+~=&]+")
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\W\d_]|[0-9@$!|])(?:[ .\-_*](?:[^\W\d_]|[0-9@$!|])){3,}(?=[\s.,;:!?]|$)")
_RUN = re.compile(r"(.)\1\1")
_STEMS = (4, 5, 6)
KEEP_COST, SWAP_COST, LOSE_COST, DROP_COST, SAME_COST = 0.0, 1.0, 12.0, 0.5, 0.3  # LOSE: a symbol that can stand for a letter
DOUBLE_COST = 4.0  # a letter that stands twice only


def symbol_classes() -> np.ndarray:
    """Class of each code point below 0x250: 1-26 plain letters, 27-63 other letters, 0 anything else."""
    out = np.zeros(0x250, np.int64)
    for c in range(0x250):
        s = chr(c).lower()
        if len(s) == 1 and s.isalpha():
            out[c] = _LETTERS.index(s) + 1 if s in _LETTERS else 27 + ord(s) % 37
    return out


CLASSES = symbol_classes()


def trigrams(texts: list[str]) -> np.ndarray:
    """Counts of class trigrams inside words; 0 stands for the word's edges."""
    total = np.zeros(SIZE**3, np.int64)
    for i in range(0, len(texts), 512):
        code = np.frombuffer("  ".join(["", *texts[i : i + 512], ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        c = CLASSES[np.where(code < len(CLASSES), code, 0)]
        tri = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
        total += np.bincount(tri[(c[1:-1] > 0) | (c[2:] > 0)], minlength=SIZE**3)
    return total


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all documents; at most 64**3 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            total += trigrams(batch.column("text").to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["g", "n"])

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE**3)
    out[rows.column("g").to_numpy()] = rows.column("n").to_numpy()
    return out


class Restorer:
    """Restores words under a trigram model with interpolated lower orders."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(SIZE, SIZE, SIZE)
        two, one = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20)
        self.cost = -np.log(p3)

    @staticmethod
    def _class(c: str) -> int:
        return int(CLASSES[ord(c)]) if ord(c) < len(CLASSES) else 0

    def decode(self, word: str) -> str:
        """Cheapest reading of ``word`` (lower case): states are the last two classes, each with a chain of
        the letters it wrote; of equal costs the one reached first is kept."""
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i, c in enumerate(word):
            letter = c.isalpha()
            reads = [(c, KEEP_COST)] if letter else [(x, SWAP_COST) for x in LEET.get(c, "")]
            drop = None if letter else LOSE_COST if c in LEET else DROP_COST
            if letter and i and word[i - 1] == c:
                long = i > 1 and word[i - 2] == c or word[i + 1 : i + 2] == c
                drop = SAME_COST if long else DOUBLE_COST
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, chain) in states.items():
                if drop is not None and cost + drop < after.get((a, b), (math.inf,))[0]:
                    after[a, b] = (cost + drop, chain)
                for x, extra in reads:
                    k = self._class(x)
                    new = cost + extra + self.cost[a, b, k]
                    if new < after.get((b, k), (math.inf,))[0]:
                        after[b, k] = (new, (chain, x))
            states = after
        _, chain = min(((cost + self.cost[a, b, 0], chain) for (a, b), (cost, chain) in states.items()), key=lambda x: x[0])
        out = []
        while chain:
            chain, x = chain
            out.append(x)
        return "".join(reversed(out))

    def words(self, token: str) -> list[str]:
        """Restored words of a token without white space."""
        low = token.lower()
        core = low.strip(_EDGE)
        if core.isalpha() and not _RUN.search(core):
            wide = low[: len(low) - len(low.lstrip("@$!|(+"))] or low[len(low.rstrip("$@|+!")) :]
            return [core] if len(wide) != 1 or wide in "!|+" else [core, self.decode(low.strip(".,;:?\"'"))]
        parts = re.findall(r"[^\W\d_]+", core)
        if not parts:
            return []
        inner = [x for x in _SEPARATORS.split(core) if len(x) > 2 and x != core and not (x.isalpha() and not _RUN.search(x))]
        return list(dict.fromkeys([self.decode(low.strip(".,;:?\"'")), self.decode(core), *map(self.decode, inner), *parts]))


def features(word: str) -> list[str]:
    return [word, *["^" + word[:n] for n in _STEMS if len(word) >= n]]


def spaced(text: str) -> list[str]:
    """Words spelled letter by letter, joined; and their inner parts of 4 to 12 letters."""
    out: list[str] = []
    for m in _SPACED.findall(text):
        s = re.sub(r"[ .\-_*]", "", m).lower()
        out += [s] if len(s) <= 12 else []
        out += [s[i:j] for i in range(len(s)) for j in range(i + 4, min(i + 12, len(s)) + 1)]
    return out


def evidence(text: str, restorer: Restorer) -> set[str]:
    """Distinct features of a restored text."""
    out: set[str] = set()
    for token in [*set(text.split()), *spaced(text)]:
        for w in restorer.words(token):
            out.update(features(w))
    return out


class Weigher(Cache):
    """token -> greatest weight of its features; kept for each worker."""

    def __init__(self, restorer: Restorer, weights: dict[str, float]):
        super().__init__("toxicity", self.weigh)
        self.restorer, self.weights = restorer, weights

    def weigh(self, token: str) -> float:
        get = self.weights.get
        return max((get(f, 0.0) for w in self.restorer.words(token) for f in features(w)), default=0.0)

    def summary(self, text: str) -> tuple[float, float]:
        """Greatest weight of a text's tokens, and the sum of the next two."""
        tokens = set(text.split())
        if _SPACED.search(text):
            tokens.update(spaced(text))
        top = sorted([v for v in map(self.__getitem__, tokens) if v > 0], reverse=True)[:3]
        return (top[0], sum(top[1:])) if top else (0.0, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; x has a leading column of ones. The last column is
    held back in proportion to the rows, so that it only adds to what the one before it says."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, 1e-2, 0.05 * len(y)])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = 3000, kept: int = 20_000) -> tuple[np.ndarray, dict[str, float], np.ndarray | None]:
    """(trigram counts, feature weights, curve). At most ``train_rows`` rows of each label are
    learned from and at most ``kept`` weights are kept."""
    spark = docs.sparkSession
    counts = count_trigrams(docs)
    part = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3))
    lab = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("y")).filter("y IN (0, 1) AND _id IS NOT NULL")
    lab = lab.groupBy("_id").agg(F.max("y").alias("y")).withColumn("doc_id", F.col("_id")).filter(part != 1).drop("doc_id")
    drawn = [lab.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(train_rows) for y in (0, 1)]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * train_rows ids
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = table(texts.join(drawn, "_id").select("text", "y"), "sample")
    shared = spark.sparkContext.broadcast(counts)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, n = Restorer(shared.value), [Counter(), Counter()]
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                n[y].update(evidence(t, restorer))
        names = list(n[0].keys() | n[1].keys())
        for a in range(0, len(names), 50_000):
            some = names[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *[pa.array([n[y][f] for f in some], pa.int64()) for y in (0, 1)]], ["f", "n0", "n1"])

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return counts, {}, None
    found = sample.mapInArrow(held, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def weight(c0, c1, of0: int, of1: int):
        """A cautious log ratio: one standard error below the estimate."""
        ratio = F.log((c1 + 0.5) / (of1 + 1.0)) - F.log((c0 + 0.5) / (of0 + 1.0))
        w = ratio - F.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
        return F.when((c1 >= 2) & (c0 >= 0) & (w > 0.5), w).otherwise(0.0)

    c0, c1 = F.col("n0"), F.col("n1")
    every, no_clean, no_toxic = weight(c0, c1, n0, n1), weight(c0 - 1, c1, n0 - 1, n1), weight(c0, c1 - 1, n0, n1 - 1)
    best = found.filter("n1 >= 2").select("f", every.alias("w"), no_clean.alias("w0"), no_toxic.alias("w1"))
    best = best.filter("w > 0 OR w0 > 0").orderBy(F.desc(F.greatest("w", "w0")), "f").limit(kept).toArrow().to_pydict()
    without = [{f: w for f, w in zip(best["f"], best[c]) if w > 0} for c in ("w0", "w1", "w")]
    weights = without[2]
    model = spark.sparkContext.broadcast((counts, without))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Evidence of each sampled row by the weights that the other rows give."""
        enter("toxicity")
        restorer = Restorer(model.value[0])
        weighers = [Weigher(restorer, w) for w in model.value[1][:2]]
        for batch in batches:
            got = np.array([weighers[y].summary(t) for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist())]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1]), batch.column("y")], ["a", "b", "y"])

    rows = sample.mapInArrow(summed, "a double, b double, y int").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    x = np.stack([np.ones(len(y)), rows.column("a").to_numpy(), rows.column("b").to_numpy()], axis=1)
    return counts, weights, _logistic(x, y)


_WEIGHERS: dict[str, Weigher] = {}
at_leaving("toxicity", _WEIGHERS.clear)


def rated(batches: Iterator[pa.RecordBatch], shared, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with the scores of their texts; a worker keeps one weigher for all its tasks."""
    enter("toxicity")
    counts, weights, curve, name = shared.value
    if name not in _WEIGHERS:
        _WEIGHERS.clear()
        _WEIGHERS[name] = Weigher(Restorer(counts), weights)
    weigher = _WEIGHERS[name]
    for whole in batches:
        for batch in slices(whole):
            got = np.array([weigher.summary(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, 2)
            yield batch, 1 / (1 + np.exp(-np.clip(curve[0] + got @ curve[1:], -40, 40)))


def scored(docs: DataFrame, labels: DataFrame, train_rows: int = 3000) -> DataFrame:
    """Adds ``score`` (0 to 1) to documents."""
    counts, weights, curve = learn(docs, labels, train_rows)
    docs = docs.drop("score")
    if curve is None:
        return docs.withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast((counts, weights, curve, uuid.uuid4().hex))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in rated(batches, shared, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_rows: int = 3000) -> DataFrame:
    """Documents whose score is below ``threshold``, with the columns they have."""
    counts, weights, curve = learn(docs, labels, train_rows)
    if curve is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((counts, weights, curve, uuid.uuid4().hex))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in rated(batches, shared, at):
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


@query("op10_deobfuscated_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(docs, load(spark, sf_dir, "labels"))
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
