"""Mixture, personal data, toxicity and the pipeline."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perfgrid.llm import op1_fair_mix as mixing
from perfgrid.llm import op3_semi_markov_pii as pii
from perfgrid.llm import op10_deobfuscated_toxicity as toxic
from perfgrid.llm.common import ORACLES, QUERIES, load, table
from pyspark.sql import functions as F

SQL = ["op1_fair_mix", "op2_segment_topk", "op4_tensor_minhash", "op9_int8_tiles"]


@pytest.mark.parametrize("name", SQL)
def test_sql_twin(spark, sf, name):
    from check_queries import compare, connect

    import perfgrid.llm

    perfgrid.llm.load_all()
    assert compare(spark, connect(sf), name, QUERIES[name], ORACLES[name], sf).startswith("ok")


def filled(sizes, weights=(5.0, 2.0, 1.0), cap=3):
    """Targets by sharing again and again."""
    names = sorted([k for k in sizes if k is not None]) + [k for k in sizes if k is None]
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [k for k in names if k not in full]
        left = total - sum(full.values())
        share = {k: left * w[k] / sum(w[j] for j in rest) for k in rest}
        over = [k for k in rest if share[k] > cap * sizes[k]]
        if not over:
            return {**full, **share}
        full.update({k: cap * sizes[k] for k in over})


@given(st.dictionaries(st.sampled_from(["a", "b", "B", "é", "z", None]), st.integers(0, 1000), min_size=1))
@settings(max_examples=12, deadline=None)
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")).collect()
    want = filled(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source], abs=1e-6)


def test_mix(spark, docs_of, odd, none):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 40)), "en", ["a", "a", "a", "b", "c", None][i % 6], 1) for i in range(600)]
    docs = docs_of(rows).withColumn("_row", F.monotonically_increasing_id())
    got = mixing.mix(table(mixing.sized(docs))).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += r[1].count("w")
    want, taken = filled(sizes), Counter()
    for r in got:
        assert 0 <= r.copies <= 3 and r.source_size == sizes[r.source]
        taken[r.source] += r.copies * r.size
    assert sum(taken.values()) <= sum(sizes.values())
    for k, v in want.items():
        assert abs(taken[k] - v) <= 45
    key = lambda rows: sorted((r.doc_id, r.copies) for r in rows)
    assert key(got) == key(mixing.mix(table(mixing.sized(docs.repartition(7)))).collect())
    for d in (odd, none):
        out = mixing.mixed_documents(d)
        assert out.columns == d.columns and len(out.collect()) <= 24
    more = docs_of(rows).selectExpr("*", "1 AS size", "2 AS copies", "3 AS _key", "4 AS target")
    assert mixing.mixed_documents(more).columns == more.columns


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "1", "22", "+1", "-", " ", "b", "4111111111111111", "255", "256", "x.y", "(", "٣"]), max_size=30).map("".join))
@settings(max_examples=500, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.fixture(scope="module")
def field(spark, sf):
    return pii.fit(load(spark, sf, "documents"), 40)


def test_field_gradient_raises_likelihood(field):
    text = "erth the a.b@mail.example.com and 10.2.3.4 here"
    (w,) = pii.windows(text)
    f = pii.Field()
    seg, gold = f.segments(text, w), pii.gold_of(text, w, pii.base_spans(text))
    for _ in range(30):
        f.step(seg, gold, 0.3)
    assert [s for s in f.best(seg)[1] if s[2]] == [g for g in gold if g[2]]


def test_pii_query(spark, odd, none, field, sf):
    docs = load(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.detect(docs, field).collect():
        base, spans = plain_spans(texts[r.doc_id]), [s for s in r.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(spans) and len(spans) == len(base) + r.n_added
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in pii.KINDS]
    assert len(pii.detect(odd, field).collect()) == 8 and pii.detect(none, field).collect() == []
    clean = {r.doc_id: r.text for r in pii.redacted(odd, field).collect()}
    assert clean[5].startswith("mail <email> or <phone> word") and clean[1] is None and clean[2] == ""


def test_restored_words():
    counts = toxic.trigrams(["you idiot and moron are stupid worthless scum of this nation with letters"] * 50)
    r = toxic.Restorer(counts)
    for seen, meant in [("m0r0n", "moron"), ("idi0t", "idiot"), ("st*pid", "stupid"), ("stuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("w0rthl3ss", "worthless"), ("$cum", "scum"), ("letters", "letters")]:
        assert meant in r.words(seen), (seen, r.words(seen))
    assert "idiot" in toxic.spaced("you i d i o t there") and toxic.spaced("a plain text") == []


def test_toxicity(spark, docs_of, none):
    rng = np.random.default_rng(5)
    plain = [f"{a}{b}" for a in ("the", "on", "er", "ti", "sh", "an") for b in ("ing", "tion", "ed", "er", "ou", "wh")]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(plain, 40))
        bad = i % 4 == 0
        if bad:
            words[7], words[21] = "moron", "stupid"
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    hidden = [(5000, "the m0r0n tion ing", "en", "s", 1), (5001, "ering s t u p i d shed", "en", "s", 1), (5002, None, None, None, None), (None, "", "en", "s", 0), (5003, "ering shed", "en", "s", 1)]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5002, 1, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows + hidden)
    got = {r.doc_id: r.score for r in toxic.scored(docs, lab).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(900))
    assert got[5000] >= 0.7 and got[5001] >= 0.7 and max(got[5002], got[None], got[5003]) < 0.7
    kept = toxic.without_toxic(docs.selectExpr("*", "1 AS score"), lab)
    assert kept.columns == [*docs.columns, "score"] and kept.count() == 675 + 3
    assert toxic.scored(none, lab).collect() == [] and {r.score for r in toxic.scored(docs, lab.limit(0)).collect()} == {0.0}


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    got = toxic.toxicity(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in load(spark, sf, "labels").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == 1000 and sum(p == y for p, y in held) / len(held) >= 0.9


def test_pipeline(spark, sf, odd):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "pii", "mix", "pack"]
    for start in (odd, odd.limit(0)):
        docs = start
        for name, stage in p.STAGES:
            out = table(stage(spark, docs, sf))
            assert name == "pack" or out.columns == start.columns
            docs = out
    rows = p.run(spark, sf).collect()
    assert rows and max(r.length for r in rows) <= 2048
