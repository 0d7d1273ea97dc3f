"""Whole texts, long runs, special strings and leftovers: cases that once were cut, slow or sent to one task."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from perfgrid.llm import op3_semi_markov_pii as pii
from perfgrid.llm import op6_best_fit as packing
from perfgrid.llm import op8_bwt_merge as bwt
from perfgrid.llm import op10_deobfuscated_toxicity as toxic
from perfgrid.llm.common import Cache, enter, load, table
from perfgrid.llm.components import components
from perfgrid.llm.encoding import TextEncoder, tokenizer_path
from perfgrid.llm.op5_packed_ids import read_ids, write_ids
from perfgrid.llm.common import new_folder


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(load(spark, "/root/testdata/sf0.01", "documents"))


def data(rng):
    card = next(c for c in ("".join(rng.choices("0123456789", k=16)) for _ in range(1000)) if pii.luhn(c))
    name, host = rng.choice(["john", "mary.smith", "a.b.c", "kim_lee", "sales", "info.desk"]), rng.choice(["example.com", "mail.example.org", "uni.edu", "a.b-c.net"])
    return {"email": f"{name}@{host}", "ip": ".".join(str(rng.randrange(256)) for _ in range(4)), "card": card, "phone": f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10000):04}"}


def test_field_recall(field):
    """At least nine tenths of every way of writing are found from end to end."""
    rng, words = random.Random(2), "the of and ti on ing tion is to there in are thshe this with for".split()
    hit, total = {}, {}
    for _ in range(150):
        for kind, x in data(rng).items():
            for n, v in enumerate(pii.variants(kind, x)):
                lead = " ".join(rng.choices(words, k=6))
                found = pii.find_spans(f"{lead} {v} {' '.join(rng.choices(words, k=6))}.", field)[1]
                total[kind, n] = total.get((kind, n), 0) + 1
                hit[kind, n] = hit.get((kind, n), 0) + ((len(lead) + 1, len(lead) + 1 + len(v), kind) in found)
    assert len(total) == 7 and all(hit[k] >= 0.9 * total[k] for k in total), hit


def test_field_leaves_clean_text_alone(spark, field):
    added = 0
    for r in pii.detect(load(spark, "/root/testdata/sf0.01", "documents"), field).collect():
        assert r.n_spans == r.n_added + r.n_email + r.n_ip + r.n_card + r.n_phone
        added += r.n_added
    assert added <= 2
    for x in ("123-45-6789", "on 2024-05-17 at 12:30", "section 3.1.4 of 100,000 pages", ""):
        assert pii.find_spans(x, field) == ([], [])


def test_best_segmentation(field):
    rng = random.Random(4)
    for _ in range(12):
        text = " ".join(rng.choice(["the", "555-1234", "12", "john", "(at)", "mail", "(dot)", "com", "(414)", "4111"]) for _ in range(6))
        for w in pii.windows(text):
            seg = field.segments(text, w)
            at = {(end - n, end): rows for end, here in enumerate(seg) for n, rows in here}
            best = -math.inf
            for cuts in itertools.product((0, 1), repeat=len(w) - 1):
                edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(w)]
                pairs = list(zip(edges, edges[1:]))
                if all(p in at for p in pairs):
                    top = np.zeros(5)
                    for n, (a, b) in enumerate(pairs):
                        into = top[:, None] + field.t if n else np.zeros((5, 5))
                        top = into.max(axis=0) + field.score(b - a, at[a, b])
                    best = max(best, top.max())
            total, path = field.best(seg)
            assert total == pytest.approx(best) and [p[0] for p in path] + [len(w)] == [0] + [p[1] for p in path]


def test_hard_texts(field):
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 5006, "ip")]
    start = time.time()
    numbers = " ".join(str(i) for i in range(10_000))
    once = time.time()
    pii.find_spans(numbers, field)
    once = time.time() - once
    (w,) = pii.windows(numbers * 10)
    assert len(w) == 99_991 and time.time() - start < 60 + 2 * once
    assert pii.find_spans("1" * 100_000, field)[0] == []
    (a, b, kind) = pii.find_spans("x " * 5000 + "call (414) 555-7134 now " + "7 " * 200, field)[1][0]
    assert (a, b, kind) == (10_005, 10_019, "phone")


def test_redaction_keeps_clashing_columns(spark, field, docs_of):
    d = docs_of([(1, "a@b.org", "en", "s", 1, "k", 2)], ", spans string, n_email long")
    out = pii.redacted(d, field)
    assert out.columns == d.columns and out.first().text == "<email>"
    assert pii.detect(d, field).columns.count("spans") == 1


def restorer():
    return toxic.Restorer(toxic.trigrams(["you idiot and moron are stupid worthless scum of this nation with letters"] * 50))


def test_lattice_enumeration():
    """The decoder finds the cheapest of all readings."""
    r, rng = restorer(), random.Random(1)
    for _ in range(60):
        word = "".join(rng.choice("io1t0mr@$.") for _ in range(rng.randrange(1, 7)))
        choices = []
        for i, c in enumerate(word):
            reads = [(c, toxic.KEEP_COST)] if c.isalpha() else [(x, toxic.SWAP_COST) for x in toxic.LEET.get(c, "")]
            if not c.isalpha():
                reads.append(("", toxic.LOSE_COST if c in toxic.LEET else toxic.DROP_COST))
            elif i and word[i - 1] == c:
                reads.append(("", toxic.SAME_COST if i > 1 and word[i - 2] == c or word[i + 1 : i + 2] == c else toxic.DOUBLE_COST))
            choices.append(reads)

        def cost(letters):
            k = [0, 0, *map(r._class, letters), 0]
            return sum(r.cost[x, y, z] for x, y, z in zip(k, k[1:], k[2:]))

        best = min(sum(p for _, p in reading) + cost("".join(x for x, _ in reading)) for reading in itertools.product(*choices))
        got = r.decode(word)
        assert min(sum(p for _, p in reading) + cost(got) for reading in itertools.product(*choices) if "".join(x for x, _ in reading) == got) == pytest.approx(best)


def test_long_tokens_and_runs():
    r = restorer()
    token = "_".join(["you", "are", "a", "w0rthl3ss", "m0r0n"] * 20)
    assert {"worthless", "moron"} <= set(r.words(token))
    assert "stupid" in r.words("st" + "u" * 90 + "p!d")
    spelled = " ".join("and" * 100 + "idiot")
    assert "idiot" in toxic.spaced(spelled)
    start = time.time()
    r.words("ab1" * 30_000)
    assert time.time() - start < 20


@pytest.mark.parametrize("folder,least", [("sf0.01", 0.6), ("sf0.1", 0.7)])
def test_toxicity_held_out(spark, folder, least):
    """Some toxic labels stand on texts without any sign of it, so recall cannot reach 1."""
    sf = f"/root/testdata/{folder}"
    labels = {r.doc_id: r.toxic for r in load(spark, sf, "labels").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in toxic.toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    hit = sum(p * y for p, y in held)
    assert hit >= least * sum(y for _, y in held) and hit >= 0.95 * sum(p for p, _ in held)


def test_score_column_is_replaced(spark, docs_of):
    d = docs_of([(1, "a", "en", "s", 1, 9.0)], ", score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxic.scored(d, none).columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]


@pytest.mark.parametrize("name,special", [("byte_bpe_50k.json", "<|endoftext|>"), ("word_bpe_49k.json", "<|startoftext|>")])
def test_special_strings_as_the_library_reads_them(spark, docs_of, name, special):
    from tokenizers import Tokenizer

    plain, enc = Tokenizer.from_file(tokenizer_path(name)), TextEncoder(tokenizer_path(name))
    texts = [f"hello {special} world", special, special.upper(), special[:-1], f"a{special}{special}b  c", "plain text"]
    for t in texts:
        assert enc.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    if name.startswith("byte"):
        d = docs_of([(i, t, "en", "s", 1) for i, t in enumerate(texts)])
        got = {r.doc_id: r.n_tokens for r in read_ids(write_ids(d, tokenizer_path(name), new_folder(spark, "ids"))).collect()}
        assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def pieces_of(spark, lengths):
    rows = spark.range(len(lengths)).select("id").join(spark.createDataFrame(list(enumerate(lengths)), "id long, length int"), "id")
    return rows.select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "length", F.lit(0).cast("long").alias("ids_crc32"), F.lit(0).cast("long").alias("tag"))


def test_pieces_that_do_not_combine(spark, monkeypatch):
    """Bins without room for the smallest one left are final at once and never meet in one task."""
    most = []
    whole = packing.table
    monkeypatch.setattr(packing, "table", lambda df, what: most.append(whole(df, what)) or most[-1])
    out = packing.pack_bins(pieces_of(spark, [1100] * 4000).repartition(16), 2048)
    assert out.select("sequence_id").distinct().count() == 4000 and len(most) == 2  # pieces, one round


def test_bounded_rounds(spark):
    rng = random.Random(3)
    lengths = [rng.choice([700, 900, 1100, 1300, 300]) for _ in range(3000)]
    out = packing.pack_bins(pieces_of(spark, lengths).repartition(16), 2048, task_members=100).collect()
    fill = {}
    for r in out:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(out) == 3000 and all(o == sum(n for p, n in b if p < o) for b in fill.values() for o, _ in b) and all(sum(n for _, n in b) <= 2048 for b in fill.values())
    assert len(fill) <= 1.1 * len(packing.best_fit(lengths, 2048))


def test_rows_given_twice_in_one_batch(spark, docs_of):
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefgh "), 400))
    other = "".join(rng.choice(list("abcdefgh "), 400))
    d = docs_of([(7, text, "en", "s", 1), (7, text, "en", "s", 1), (8, other, "en", "s", 1)]).coalesce(1)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in bwt.without_repeats(d).collect())
    assert got == [(7, 400, 0), (7, 400, 400), (8, 400, 0)]


@pytest.mark.parametrize("few", [0, 500_000])
def test_components_in_rounds_and_at_once(spark, few):
    rng = random.Random(4)
    edges = [(0, x) for x in range(1, 1500)] + [(x, x + 1) for x in range(5000, 5040)] + [(1499, 5000)] + [(rng.randrange(9000, 9300), rng.randrange(9000, 9300)) for _ in range(200)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long"), few).collect() == []


def test_cache_is_bounded():
    made = []
    c = Cache("one", lambda k: made.append(k) or len(k), limit=1000, longest=8)
    assert [c["ab"], c["ab"], c["x" * 9], c["x" * 9]] == [2, 2, 9, 9] and made == ["ab", "x" * 9, "x" * 9]
    for i in range(50):
        c[str(i)]
        assert len(c) <= 5
    enter("two")
    assert len(c) == 0
