"""Token counts of a unigram tokenizer without making its tokens.

An Aho-Corasick automaton lists all vocabulary pieces that end at each place of a word; dynamic
programming carries the best score and its number of pieces. Ties go to the piece that starts
first, and a character without a piece of its own costs ten below the least score and
counts its UTF-8 bytes, as the tokenizer's byte pieces do. Words repeat, so each worker keeps the
counts it found last.

The pieces are those of a public vocabulary file; a unigram score is the logarithm of a
Zipf law over the piece's number. ``reference_tokenizer`` is the library's tokenizer of that
vocabulary, whose counts these are.

Nulls: a NULL text has 0 tokens; a NULL doc_id stays. Repeated rows are counted each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfgrid.llm.common import load, query
from perfgrid.llm.encoding import tokenizer_path

BLANK = "▁"


def vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), -math.log(i + 2.0)) for i in range(sp.get_piece_size())]


def reference_tokenizer(path: str):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = vocabulary(path)
    tok = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement=BLANK, prepend_scheme="always", split=True)
    return tok


class Counter(dict):
    """word -> number of pieces."""

    def __init__(self, path: str, keep: int = 500_000):
        super().__init__()
        pieces = vocabulary(path)
        self.keep, self.automaton = keep, ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in pieces:
            scores.setdefault(piece, score)
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - 10.0

    def __missing__(self, word: str) -> int:
        if len(self) >= self.keep:
            self.clear()
        n = self[word] = self.count(word)
        return n

    def count(self, word: str) -> int:
        ends: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, found in self.automaton.iter(word):
            ends[end].append(found)
        best, pieces = [0.0], [0]
        for end, char in enumerate(word):
            top, n, single = None, 0, False
            for length, score in sorted(ends[end], reverse=True):  # the earliest start first
                s = best[end + 1 - length] + score
                single = single or length == 1
                if top is None or s > top:
                    top, n = s, pieces[end + 1 - length] + 1
            if not single:
                s = best[end] + self.unknown
                if top is None or s > top:
                    top, n = s, pieces[end] + len(char.encode("utf-8", "surrogatepass"))
            best.append(top)
            pieces.append(n)
        return pieces[-1]

    def text(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(" ", BLANK).split(BLANK)
        if not words[0]:
            words = words[1:]
        return sum([self[w] for w in [BLANK + w for w in words]])


_LOADED: dict[str, Counter] = {}


def counted(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Counter(path)
        c = _LOADED[path]
        for batch in batches:
            n = [c.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.mapInArrow(run, "doc_id long, n_tokens long")


@query("op7_unigram_counts")
def unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
