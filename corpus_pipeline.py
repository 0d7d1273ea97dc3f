"""Corpus pipeline: toxicity, near-duplicates, personal data, mixture, packing.

Each stage works on all that the one before kept and is written and read again, so a lost executor
costs at most one stage. Nulls, empty texts, repeated rows and empty tables have the results that the
operators' docstrings state; further columns of ``documents`` pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfgrid.llm.common import load, query, table
from perfgrid.llm.encoding import tokenizer_path
from perfgrid.llm.op1_fair_mix import mixed_documents
from perfgrid.llm.op3_semi_markov_pii import fit, redacted
from perfgrid.llm.op4_tensor_minhash import without_near
from perfgrid.llm.op6_best_fit import cut_pieces, pack_bins
from perfgrid.llm.op10_deobfuscated_toxicity import without_toxic
from perfgrid.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SEQUENCE = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity score rejects (0.7 or more)."""
    ship(spark)
    return without_toxic(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with similarity 0.8 or more on five-word shingles."""
    ship(spark)
    return without_near(docs, words=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the text."""
    ship(spark)
    out = redacted(docs, fit(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some of them several times, so that sources come near their target words."""
    ship(spark)
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token pieces of all rows into sequences."""
    ship(spark)
    pieces = cut_pieces(docs, tokenizer_path("word_bpe_49k.json"), SEQUENCE)
    return pack_bins(pieces, SEQUENCE).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact),
    ("mix", mix_sources),
    ("pack", pack),
]

#: SQL can express neither the learned stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


query("pipeline")(run)
