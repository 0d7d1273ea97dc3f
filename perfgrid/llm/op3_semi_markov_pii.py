"""Personal data by patterns and a semi-Markov conditional random field.

Base spans come from one pattern for each kind. Around tokens with a digit, an at sign or a
spelled-out sign, a semi-Markov field chooses boundaries and kinds together: a segment of up to
``LONGEST`` tokens is scored by features of the whole span (shape, digits, groups, checksum, the word
before it), and dynamic programming over the whole window takes the best segmentation. Base
spans are fixed; spans of the field that touch none of them are added when they beat the reading
without them by ``margin``.

A segment of several tokens begins and ends at or beside a token with a sign or digit, has at
most 24 digits, and beyond six tokens every other one of them is a spelled-out sign: no kind of
personal data has another form.

The field is trained here, by the gradient of its likelihood, on a bounded sample: ``train_docs``
snippets of 300 characters around the first candidate of a document, by hash order, whose base
spans are the labels, together with variants of these spans written in ways that the patterns miss
(no plus sign, spelled-out signs, other separators).

Nulls: a NULL text is empty; a NULL doc_id stays. Repeated rows are searched each. Texts are
searched whole, in time linear in their length. An empty table gives no rows, and a table without any
base span trains a field that adds nothing. Other columns are kept by ``redacted`` and not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfgrid.llm.common import load, query

KINDS = ("email", "ip", "card", "phone")
LONGEST, AROUND = 15, 2
Span = tuple[int, int, str]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"[\[({] ?(?:at|dot|AT|DOT) ?[\])}]")
_ANY = re.compile(r"[0-9@]|" + _SPELLED.pattern)
_CANDIDATE = r"@[A-Za-z0-9-]+\.|[0-9]{3,}.?[0-9]{3,}|\+[0-9]|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]"
_TOKEN = re.compile(r"[\[({] (?:at|dot|AT|DOT) [\])}]|\S+")  # a sign spelled with blanks inside is one token
_TRIM_L, _TRIM_R = "\"'<{[,;:", "\"'>}],;:.!?"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def part_of_ip(digits: str) -> bool:
    """At most 255, whatever the number of leading zeros."""
    d = digits.lstrip("0")
    return len(d) <= 3 and (not d or int(d) <= 255)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and then kind. The address pattern is applied at each at sign: what
    stands before it is the run of its characters, which is where the pattern would begin."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(part_of_ip(p) for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def hot_tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Spans of the tokens that hold a digit, an at sign or (a part of) a spelled-out sign."""
    end, out = len(text) if end is None else end, []
    for m in _ANY.finditer(text, start, end):
        lo, hi = m.span()
        if out and hi <= out[-1][1]:
            continue
        while lo > start and not text[lo - 1].isspace():
            lo -= 1
        while hi < end and not text[hi].isspace():
            hi += 1
        out += [t.span() for t in _TOKEN.finditer(text, max(lo, out[-1][1] if out else lo), hi)]
    return out


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of token spans: tokens that can belong to an entity and AROUND tokens on either side, of
    those that stand within 80 characters. Runs that meet are one."""
    out: list[list[tuple[int, int]]] = []
    for lo, hi in hot_tokens(text):
        left = [m.span() for m in _TOKEN.finditer(text, max(0, lo - 80), lo)][-AROUND:]
        right = [m.span() for m in _TOKEN.finditer(text, hi, min(len(text), hi + 80))][:AROUND]
        w = [s for s in left if s[0] == 0 or text[s[0] - 1].isspace()] + [(lo, hi)]
        w += [s for s in right if s[1] == len(text) or text[s[1]].isspace()]
        if out and w[0][0] <= out[-1][-1][1]:
            last = out[-1][-1][0]
            out[-1] += [s for s in w if s[0] > last]
        else:
            out.append(w)
    return out


def core(text: str, lo: int, hi: int) -> tuple[int, int]:
    """A span without punctuation that does not belong to an entity."""
    while lo < hi and text[lo] in _TRIM_L:
        lo += 1
    while hi > lo and text[hi - 1] in _TRIM_R:
        hi -= 1
    while hi > lo and text[hi - 1] == ")" and "(" not in text[lo:hi]:
        hi -= 1
    return lo, hi


def span_features(text: str, lo: int, hi: int, tokens: int) -> list[str]:
    """Features of a whole span."""
    lo, hi = core(text, lo, hi)
    s = text[lo:hi]
    d = re.sub(r"\D", "", s)
    letters = sum(c.isalpha() for c in s)
    groups = re.findall(r"\d+", s)
    shape = re.sub(r"9+", "9", re.sub(r"[a-z]+", "a", re.sub(r"[0-9]", "9", s.lower())))
    marks = "".join(sorted(set(re.sub(r"[a-z0-9\s]", "", s.lower()))))
    size = next(i for i, m in enumerate((0, 3, 6, 8, 11, 15, 19, 10**9)) if len(d) <= m)
    before = re.search(r"([^\W\d_]+)\W*$", text[max(0, lo - 24) : lo])
    quads = len(groups) == 4 and all(part_of_ip(g) for g in groups)
    signs = [m.group().strip("[](){} ").lower() for m in _SPELLED.finditer(text, lo, hi)]
    at, dot = signs.count("at"), signs.count("dot")
    edge = "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in (s[:1], s[-1:]))
    return [
        "1", f"n{min(tokens, 4)}", f"d{size}", f"s{shape[:24]}", f"m{marks}", f"l{min(letters, 12) // 3}{letters > 0}", f"g{min(len(groups), 6)}",
        f"G{','.join(str(min(len(g), 9)) for g in groups[:6])}{letters > 0}",
        f"q{quads}", f"c{12 <= len(d) <= 19 and luhn(d)}{letters > 0}", f"@{'@' in s}{s.count('.') > 0}", f"t{min(at, 2)}{min(dot, 1)}{at + dot > 0 and edge}", f"e{edge}", f"+{s[:1] == '+'}{size}",
        f"w{before.group(1).lower() if before else ''}",
    ]


class Field:
    """Semi-Markov field over the kinds; label 0 is a token outside any entity."""

    def __init__(self, size: int = 1 << 14):
        self.w = np.zeros((size, len(KINDS) + 1))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def rows(self, names: list[str]) -> np.ndarray:
        return np.array([int.from_bytes(hashlib.blake2b(f.encode("utf-8", "surrogatepass"), digest_size=4).digest()) % len(self.w) for f in names])

    def candidates(self, text: str, window: list[tuple[int, int]]) -> Iterator[list[tuple[int, np.ndarray]]]:
        """For each end, (length, feature rows) of its candidate segments."""
        starts = {lo for lo, _ in hot_tokens(text, window[0][0], window[-1][1])}
        hot = [lo in starts for lo, _ in window]
        digits = np.concatenate([[0], np.cumsum([sum(c.isdigit() for c in text[lo:hi]) for lo, hi in window])])
        signs = np.concatenate([[0], np.cumsum([bool(_SPELLED.match(text, max(0, lo - 2))) or bool(_SPELLED.match(text, lo)) for lo, _ in window])])
        for end in range(1, len(window) + 1):
            here = []
            for n in range(1, min(LONGEST, end) + 1):
                first = end - n
                if n > 1 and digits[end] - digits[first] > 24:
                    break
                if n > 6 and 2 * (signs[end] - signs[first]) + 1 < n:
                    continue
                if n == 1 or (hot[end - 1] or hot[end - 2]) and (hot[first] or hot[first + 1]):
                    here.append((n, self.rows(span_features(text, window[first][0], window[end - 1][1], n))))
            yield here

    def segments(self, text: str, window: list[tuple[int, int]]) -> list[list[tuple[int, np.ndarray]]]:
        """The candidates of all ends at once, an empty list in front; for training."""
        return [[], *self.candidates(text, window)]

    def score(self, n: int, rows: np.ndarray) -> np.ndarray:
        s = self.w[rows].sum(axis=0)
        if n > 1:
            s[0] = -np.inf
        return s

    def best(self, segments: Iterable[list[tuple[int, np.ndarray]]]) -> tuple[float, list[tuple[int, int, int]]]:
        """Score and segments (first token, end, label) of the best segmentation. Candidates may come one
        end after the other; two bytes a label and end are kept."""
        kinds, flat = len(self.t), np.zeros_like(self.t)
        top, back = [np.zeros(kinds)], []
        for end, here in enumerate(segments):
            if not end:
                continue
            best, how = np.full(kinds, -np.inf), np.zeros((kinds, 2), np.int8)
            for n, rows in here:
                into = top[end - n][:, None] + (self.t if end > n else flat)
                prior = into.argmax(axis=0)
                s = self.score(n, rows) + into[prior, np.arange(kinds)]
                better = s > best
                best[better] = s[better]
                how[better] = np.stack([np.full(kinds, n), prior], axis=1)[better]
            top.append(best)
            back.append(how)
        end, y, out = len(back), int(top[-1].argmax()), []
        total = float(top[-1].max())
        while end > 0:
            n, prior = (int(x) for x in back[end - 1][y])
            out.append((end - n, end, y))
            end, y = end - n, prior
        return total, out[::-1]

    def step(self, segments: list[list[tuple[int, np.ndarray]]], gold: list[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the log-likelihood of ``gold``."""
        n = len(segments) - 1
        flat = np.zeros_like(self.t)
        lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        alpha = [np.zeros(len(self.t))] + [np.full(len(self.t), -np.inf) for _ in range(n)]
        beta = [np.full(len(self.t), -np.inf) for _ in range(n)] + [np.zeros(len(self.t))]
        scores = [[self.score(k, r) for k, r in seg] for seg in segments]
        with np.errstate(invalid="ignore"):
            for end in range(1, n + 1):
                for (k, _), s in zip(segments[end], scores[end]):
                    start = alpha[end - k] if end > k else np.where(np.arange(len(self.t)) == 0, 0.0, -np.inf)
                    alpha[end] = np.logaddexp(alpha[end], s + lse(start[:, None] + (self.t if end > k else flat), 0))
            for end in range(n, 0, -1):
                for (k, _), s in zip(segments[end], scores[end]):
                    if end > k:
                        beta[end - k] = np.logaddexp(beta[end - k], lse(self.t + (s + beta[end])[None, :], 1))
            total = lse(alpha[n], 0)
            want = {(a, b): y for a, b, y in gold}
            prior = {b: y for _, b, y in gold}
            for end in range(1, n + 1):
                for (k, rows), s in zip(segments[end], scores[end]):
                    start = alpha[end - k] if end > k else np.where(np.arange(len(self.t)) == 0, 0.0, -np.inf)
                    pair = np.exp(start[:, None] + (self.t if end > k else flat) + (s + beta[end])[None, :] - total)
                    grad = -pair.sum(axis=0)
                    y = want.get((end - k, end))
                    if y is not None:
                        grad[y] += 1
                    np.add.at(self.w, rows, rate * grad[None, :])
                    if end > k:
                        self.t -= rate * pair
                        if y is not None:
                            self.t[prior[end - k], y] += rate


def gold_of(text: str, window: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int, int]]:
    """The segmentation that the given spans make of a window."""
    out, i = [], 0
    while i < len(window):
        hit = next((s for s in spans if s[0] < window[i][1] and s[1] > window[i][0]), None)
        j = i + 1
        if hit:
            while j < len(window) and window[j][0] < hit[1]:
                j += 1
        if hit and j - i <= LONGEST:
            out.append((i, j, KINDS.index(hit[2]) + 1))
        else:
            out += [(k, k + 1, 0) for k in range(i, j)]
        i = j
    return out


def variants(kind: str, s: str) -> list[str]:
    """The same datum written so that the base patterns miss it."""
    d = re.sub(r"\D", "", s)
    if kind == "email":
        return [s.replace("@", f"{a}at{b}").replace(".", f"{a}dot{b}") for a, b in ((" (", ") "), ("[", "]"), (" [ ", " ] "))]
    if kind == "phone" and len(d) >= 10:
        return [f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}"]
    if kind == "ip":
        return [s.replace(".", "[.]")]
    if kind == "card":
        return [".".join(d[i : i + 4] for i in range(0, len(d), 4))]
    return []


def forms(kind: str, s: str) -> list[str]:
    """A datum and, for an address, shorter ones of the same make."""
    if kind != "email":
        return [s]
    local, host = s.split("@")
    plain, parts = re.sub(r"[^A-Za-z]", "", local) or "a", host.split(".")
    return list(dict.fromkeys([s, f"{plain}@{'.'.join(parts[-2:])}", f"{plain}.{parts[0]}@{host}", f"{plain}_{parts[0]}@{parts[0]}-{parts[-1]}.{host}", f"{local}@{'.'.join(parts[-2:])}"]))


def train(texts: list[str], epochs: int = 15) -> Field:
    """Field learned from texts of bounded number; texts are visited in the given order."""
    field, data = Field(), []
    for text in texts:
        spans = base_spans(text)
        shown = [(text, spans)]
        for a, b, kind in spans:
            lo, hi = max(0, a - 60), min(len(text), b + 60)
            for v in [v for form in forms(kind, text[a:b]) for v in variants(kind, form)]:
                shown.append((text[lo:a] + v + text[b:hi], [(a - lo, a - lo + len(v), kind)]))
        shown += [(f"{text[:40]} {x} {text[40:80]}", []) for x in ("2024-05-17", "12:30", "3.14", "1999", "v2.10", "100,000", "7", "123-45-6789", "(3) 17-4")] if spans else []
        for t, s in shown:
            data += [(field.segments(t, w), gold_of(t, w, s)) for w in windows(t)]
    for epoch in range(epochs):
        for segments, gold in data:
            field.step(segments, gold, 0.2 / (1 + epoch))
    return field


class Covered:
    """Whether a span meets one of the given spans."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for a, b, _ in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, lo: int, hi: int) -> bool:
        at = bisect_left(self.starts, hi) - 1
        return at >= 0 and self.ends[at] > lo


def added_spans(field: Field, text: str, base: list[Span], margin: float) -> list[Span]:
    """Spans of the field that touch no base span and beat the reading without them by ``margin``."""
    out: list[Span] = []
    covered = Covered(base)
    of = lambda w, a, b: field.rows(span_features(text, w[a][0], w[b - 1][1], b - a))
    for w in windows(text):
        if all(covered.meets(a, b) for a, b in hot_tokens(text, w[0][0], w[-1][1])):
            continue
        _, best = field.best(chain([[]], field.candidates(text, w)))
        for first, end, y in best:
            if y:
                lo, hi = core(text, w[first][0], w[end - 1][1])
                if lo < hi and not covered.meets(lo, hi):
                    outside = sum(field.score(1, of(w, i, i + 1))[0] for i in range(first, end))
                    if field.score(end - first, of(w, first, end))[y] - outside >= margin:
                        out.append((lo, hi, KINDS[y - 1]))
    return out


def find_spans(text: str, field: Field | None, margin: float = 0.5) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    more = added_spans(field, text, base, margin) if field else []
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def fit(docs: DataFrame, train_docs: int = 150) -> Field:
    """Trains on at most ``train_docs`` snippets of 300 characters; at most four times as many
    candidates reach the driver."""
    at = F.regexp_instr(F.col("text").cast("string"), F.lit(_CANDIDATE))
    texts = docs.select(F.col("text").cast("string").alias("text"), at.alias("at")).filter("at > 0")
    texts = texts.select(F.substring("text", F.greatest(F.lit(1), F.col("at") - 120), F.lit(300)).alias("text"))
    rows = texts.distinct().orderBy(F.xxhash64("text"), "text").limit(4 * train_docs).toArrow()
    return train([t for t in rows.column("text").to_pylist() if base_spans(t)][:train_docs])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame, field: Field, margin: float = 0.5) -> DataFrame:
    """doc_id, n_<kind> of base spans, base_sha256, spans, n_added, n_spans (of all spans)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for t in batch.column("text").to_pylist():
                base, every = find_spans(t, field, margin)
                n = [sum(s[2] == k for s in base) for k in KINDS]
                for col, v in zip(cols, (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base), len(every))):
                    col.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_spans"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, n_spans long")


def redacted(docs: DataFrame, field: Field, margin: float = 0.5) -> DataFrame:
    """Documents with every span replaced by its kind in angle brackets; other columns stay."""
    shared, names, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns, docs.columns.index("text")

    def clean(t: str | None, field: Field) -> str | None:
        if not t:
            return t
        out, end = [], 0
        for a, b, kind in find_spans(t, field, margin)[1]:
            if b <= end:
                continue
            out += [t[end : max(a, end)], f"<{kind}>"]
            end = b
        return "".join([*out, t[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array([clean(t, field) for t in cols[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)


@query("op3_semi_markov_pii")
def semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return detect(docs, fit(docs))
