"""Packed ids, best-fit packing and token counts against the libraries themselves."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perfgrid.llm import op5_packed_ids as packed
from perfgrid.llm import op6_best_fit as fit
from perfgrid.llm import op7_unigram_counts as counts
from perfgrid.llm.common import new_folder
from perfgrid.llm.encoding import encoder, tokenizer_path

BYTE, WORD, PIECE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
TEXTS = st.lists(st.sampled_from(list("aBé ß\n\t .,!'’0١9漢🎉́İ<|>") + ["  ", "'s", "<|endoftext|>", " word"]), max_size=40).map("".join)


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_encoder_equals_library(name):
    enc = encoder(tokenizer_path(name))

    @settings(max_examples=300, deadline=None)
    @given(TEXTS)
    def check(text):
        assert enc.ids(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids

    check()


@given(st.integers(1, 32), st.integers(0, 400), st.integers(0, 2**31))
@settings(max_examples=80, deadline=None)
def test_pack_round_trip(width, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
    assert packed.unpack(packed.pack(ids, width), width)[:n].tolist() == ids.tolist()


def test_random_access():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50257, 700_000).astype(np.uint16)
    data = b"".join(packed.file_bytes(np.array([7]), np.array([0, len(ids)]), [ids], 50257))
    f = packed.PackedFile(data)
    for a, b in [(0, 1), (4095, 4097), (262_143, 262_145), (699_999, 700_000), (5, 5), (10, 600_000)]:
        assert f.ids(a, b).tolist() == ids[a:b].tolist()


def want_ids(rows):
    tok = encoder(tokenizer_path(BYTE)).tok
    at, out = 0, []
    for d, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_packed_ids(spark, odd, none, sf):
    from tests_llm_rows import ODD

    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    path = tokenizer_path(BYTE)
    got = packed.read_ids(packed.write_ids(odd, path, new_folder(spark, "ids"))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want_ids(ODD), key=key)
    assert packed.read_ids(packed.write_ids(none, path, new_folder(spark, "ids"))).collect() == []
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, packed.packed_ids(spark, sf).collect())) == want_ids(rows)


def checked_bins(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for at, n in sorted(b):
            assert at == end
            end += n
        assert end <= size
    return len(bins)


def test_best_fit(spark, odd, none, sf):
    from tests_llm_rows import ODD

    path, tok = tokenizer_path(WORD), encoder(tokenizer_path(WORD)).tok
    for docs, rows in ((odd, [(r[0], r[1]) for r in ODD]), (spark.read.parquet(f"{sf}/documents.parquet"), None)):
        rows = rows or [(r.doc_id, r.text) for r in docs.collect()]
        got = fit.pack_bins(fit.cut_pieces(docs, path, 2048), 2048).collect()
        want = []
        for d, t in rows:
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            want += [(d, i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for i, a in enumerate(range(0, len(ids), 2048))]
        assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
        total = sum(w[3] for w in want)
        assert checked_bins(got, 2048) <= 1.02 * total / 2048 + 2
    assert fit.pack_bins(fit.cut_pieces(none, path, 2048), 2048).collect() == []


def test_best_fit_is_best_fit():
    assert sorted(map(sorted, fit.best_fit([6, 5, 4, 3, 2], 10))) == [[0, 2], [1, 3, 4]]
    assert fit.best_fit([], 10) == []


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_unigram_equals_library(text):
    path = tokenizer_path(PIECE)
    global _REF
    if _REF is None:
        _REF = counts.reference_tokenizer(path), counts.Counter(path)
    assert _REF[1].text(text) == len(_REF[0].encode(text, add_special_tokens=False).ids)


_REF = None


def test_unigram_query(spark, odd, none, sf):
    path = tokenizer_path(PIECE)
    ref = counts.reference_tokenizer(path)
    n = lambda t: len(ref.encode(t or "", add_special_tokens=False).ids)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id: r.n_tokens for r in counts.unigram_counts(spark, sf).collect()} == {r.doc_id: n(r.text) for r in docs.collect()}
    assert sorted((r.n_tokens for r in counts.counted(odd, path).collect())) == sorted(n(r.text) for r in odd.collect())
    assert counts.counted(none, path).collect() == []
