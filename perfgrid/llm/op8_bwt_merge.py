"""Repeated 100-byte strings by merging Burrows-Wheeler transforms of shards.

A window of ``span`` bytes has one anchor: the leftmost of its 24-byte grams with the least
hash. Equal windows have equal anchors at equal places, so windows are compared only where
anchors are equal, and an anchor is met about once in 39 bytes.

1. Each anchor is sent to a partition of its hash with a digest of its context, all bytes of the
   windows that it anchors. Of anchors with one context only the first keeps its windows;
   copies inside a batch are settled before the shuffle.
2. Where one anchor has several contexts that agree on the half before or the half after it, as two have to
   that share a window, these are fetched once each and their 8-byte words form
   strings, rightwards and leftwards. Shards of strings get a Burrows-Wheeler transform each; two
   transforms are merged by refining their interleave word by word, which sorts all suffixes
   by one more word a round and shows, where a block first splits, the common prefix. Merging goes
   on up a tree of shards; no suffix is sorted again. Common prefixes of both sides give, for
   each place of the anchor in a window, the classes of equal windows, and all but the first of a
   class are removed.

Nulls: a NULL text is empty; a NULL doc_id comes before all others. Rows of one doc_id are ordered
by text hash; of rows that agree in both, all but one are later copies of it. Documents below
``span`` bytes lose nothing. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfgrid.llm.common import load, query, table
from perfgrid.llm.op4_tensor_minhash import mixed

GRAM = 24
NO_ID = np.iinfo(np.int64).min
_C = np.random.default_rng(8).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def words_at(buf: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte word from each place on; ``buf`` ends in at least 8 bytes of padding."""
    n = len(buf) - 8
    out = np.empty(n, np.uint64)
    for o in range(8):
        part = out[o::8]
        part[:] = np.frombuffer(buf.data, ">u8", len(part), o)
    return out


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(place, document number, least and greatest distance from a window's start to the anchor, hash) for each
    anchor of the documents buf[starts:ends]; ``buf`` has 32 bytes of padding at its end."""
    reach = span - GRAM + 1
    n = len(buf) - 32
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none, np.zeros(0, np.uint64)
    w = words_at(buf)
    h = mixed(w[: n - GRAM + 1] * _C[0] + mixed(w[8 : n - GRAM + 9] * _C[1]) + mixed(w[16 : n - GRAM + 17]) * _C[2])
    low = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < reach:
        low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
    inside = np.zeros(n + 1, np.int32)
    long = ends - starts >= span
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - span + 1, -1)
    s = np.flatnonzero(np.cumsum(inside[: len(low)]) > 0)
    if not len(s):
        return none, none, none, none, np.zeros(0, np.uint64)
    a = (low[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    last = np.concatenate([first[1:], [len(a)]]) - 1
    at = a[first]
    return at, np.searchsorted(starts, at, "right") - 1, at - s[last], at - s[first], h[at]


def contexts(buf: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int) -> np.ndarray:
    """Bytes from span - GRAM before each anchor to span after it, zero outside [lo, hi)."""
    left, width = span - GRAM, 2 * span - GRAM
    padded = np.concatenate([np.zeros(left, np.uint8), buf, np.zeros(span, np.uint8)])
    got = np.lib.stride_tricks.sliding_window_view(padded, width)[at].copy()
    cut = np.flatnonzero((at - left < lo) | (at + span > hi))
    if len(cut):
        place = at[cut, None] - left + np.arange(width)
        got[cut] *= (place >= lo[cut, None]) & (place < hi[cut, None])
    return got


def digests(rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes and of further integers."""
    pad = -rows.shape[1] % 8
    words = np.pad(rows, ((0, 0), (0, pad))).view("<u8")
    out = np.zeros(len(rows), np.uint64)
    for i, col in enumerate([*words.T, *more]):
        out = mixed(out * _C[3] + mixed(col.astype(np.uint64) + _C[4 + i % 32]))
    return out


class Transform:
    """Transform of a set of strings (rows of words), its suffixes in order: the word before each
    (``before``, where ``has``), its string and its place. The empty suffixes stand first.
    ``common``: words that a suffix shares with the one before it."""

    def __init__(self, before, has, string, place, common, strings):
        self.before, self.has, self.string, self.place, self.common, self.strings = before, has, string, place, common, strings


def _split(block: np.ndarray, symbols: np.ndarray, strings: int) -> np.ndarray:
    """Where blocks start when suffixes, sorted by one more word, are told apart by that word and by their former blocks."""
    new = np.ones(strings + len(symbols), bool)
    new[1:strings] = False
    new[strings + 1 :] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
    return new


def transform(text: np.ndarray) -> Transform:
    """Transform of one shard by refining the order of all its suffixes from words of the right end on."""
    n, w = text.shape
    order = np.concatenate([np.arange(w * n, w * n + n), np.arange(w * n)])
    flat = np.ascontiguousarray(text.T).ravel()  # a suffix is numbered place * n + string
    block, common = np.zeros(len(order), np.int64), np.full(len(order), -1)
    for depth in range(w):
        at = np.flatnonzero(order >= n)
        at = at[np.argsort(flat[order[at] - n], kind="stable")]
        new = _split(block[at], flat[order[at] - n], n)
        order = np.concatenate([order[:n], order[at] - n])
        common[new & (common < 0)] = depth
        block = np.cumsum(new)
    place, string = order // n, order % n
    common = np.where(common < 0, w - place, common)
    has = place > 0
    before = np.zeros(len(order), np.uint64)
    before[has] = flat[order[has] - n]
    return Transform(before, has, string, place, common, n)


def merge(a: Transform, b: Transform) -> Transform:
    """Merged transform from the two alone: ``side`` tells for each merged suffix which one it is from,
    and a round of refinement sends it to the bucket of the word before."""
    side = np.concatenate([np.zeros(a.strings, bool), np.ones(b.strings, bool), np.zeros(len(a.has) - a.strings, bool), np.ones(len(b.has) - b.strings, bool)])
    n, w = a.strings + b.strings, int(max(a.place.max(initial=0), b.place.max(initial=0)))
    block, common = np.zeros(len(side), np.int64), np.full(len(side), -1)

    def laid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty(len(side), x.dtype)
        out[~side], out[side] = x, y
        return out

    for depth in range(w):
        before, has = laid(a.before, b.before), laid(a.has, b.has)
        at = np.flatnonzero(has)
        at = at[np.argsort(before[at], kind="stable")]
        new = _split(block[at], before[at], n)
        now = np.concatenate([side[:n], side[at]])
        common[new & (common < 0)] = depth
        blocks = np.cumsum(new)
        done = depth and (now == side).all() and (blocks == block).all()
        side, block = now, blocks
        if done:
            break
    place = laid(a.place, b.place)
    common = np.where(common < 0, w - place, common)
    return Transform(laid(a.before, b.before), laid(a.has, b.has), laid(a.string, b.string + a.strings), place, common, n)


def ordered(rows: np.ndarray, shard: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings given as rows of bytes, and the bytes each shares with the one before it: by
    a tree of merges over the transforms of shards."""
    text = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8").astype(np.uint64)
    level = [transform(text[i : i + shard]) for i in range(0, len(text), shard)]
    while len(level) > 1:
        level = [merge(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    t = level[0]
    whole = np.flatnonzero(t.place == 0)
    order, words = t.string[whole], np.minimum.reduceat(t.common[: whole[-1] + 1], np.concatenate([[0], whole[:-1] + 1]))
    shared = np.zeros(len(order), np.int64)
    full = words[1:] >= text.shape[1]
    k = np.minimum(words[1:], text.shape[1] - 1)
    differ = text[order[1:], k] ^ text[order[:-1], k]
    shared[1:] = 8 * k + sum((differ >> np.uint64(64 - 8 * b) == 0).astype(np.int64) for b in range(1, 8)) + (full & (differ == 0))
    return order, shared


def repeated(rows: np.ndarray, least: np.ndarray, most: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts in document order: those with windows that also start earlier, with the least and
    greatest distance of such a window's start to the anchor. A context anchors the windows from
    ``least`` to ``most`` before it; their union is without a gap."""
    left, n = span - GRAM, len(rows)
    r_order, r_shared = ordered(rows[:, left:])
    l_order, l_shared = ordered(rows[:, :left][:, ::-1])
    lo, hi = np.full(n, span), np.full(n, -1)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(left + 1):
        some = np.flatnonzero((least <= d) & (d <= most))
        if len(some) < 2:
            continue
        r_class[r_order] = np.cumsum(r_shared < span - d)
        l_class[l_order] = np.cumsum(l_shared < d)
        key = r_class[some] * (n + 1) + l_class[some]
        later = np.ones(len(some), bool)
        later[np.unique(key, return_index=True)[1]] = False
        some = some[later]
        lo[some], hi[some] = np.minimum(lo[some], d), d
    out = np.flatnonzero(hi >= 0)
    return out, lo[out], hi[out]


_COLS = ["ids", "keys", "doc", "x", "y", "h", "c", "r"]
_TYPES = dict(zip(_COLS, ["<i8", "<i8", "<u4", "<u4", "<u4", "<u4", "<u8", "<u2"]))
_SCHEMA = "kind int, part int, ids binary, keys binary, doc binary, x binary, y binary, h binary, c binary, r binary"
ANCHOR, SPAN, WANTED, BYTES = range(4)


def blobs(kind: int, part: np.ndarray, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, x: np.ndarray, y: np.ndarray, h=None, c=None, r=None) -> list[tuple]:
    """One row for each value of ``part``; ``ids`` and ``keys`` are those of the documents that ``doc`` numbers."""
    order, out = np.argsort(part, kind="stable"), []
    edges = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, edges) if len(order) else []:
        used, number = np.unique(doc[rows], return_inverse=True)
        cols = [ids[used], keys[used], number, x[rows], y[rows]] + [b"" if v is None else v[rows] for v in (h, c, r)]
        out.append((kind, int(part[rows[0]]), *[v if isinstance(v, bytes) else v.astype(_TYPES.get(k, v.dtype) if v.ndim == 1 else v.dtype).tobytes() for k, v in zip(_COLS, cols)]))
    return out


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * len(_COLS)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["kind", "part", *_COLS])


def unblob(t: pa.Table, width: int = 0) -> dict[str, np.ndarray]:
    """Columns of all rows, documents by their ids and keys; ``width``: c holds rows of so many bytes."""
    out = {k: np.frombuffer(b"".join(t.column(k).to_pylist()), "u1" if k == "c" and width else _TYPES[k]) for k in _COLS}
    docs = [len(v) // 8 for v in t.column("ids").to_pylist()]
    items = [len(v) // 4 for v in t.column("doc").to_pylist()]
    number = out["doc"].astype(np.int64) + np.repeat(np.cumsum([0, *docs[:-1]]), items)
    out["ids"], out["keys"] = out["ids"][number], out["keys"][number]
    if width:
        out["c"] = out["c"].reshape(-1, width)
    return out


def bucket(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _texts(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes with padding, starts, ends) of runs of rows of about ``limit`` bytes."""
    texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        ends = np.cumsum([len(t) for t in texts[i:j]])
        yield i, j, np.frombuffer(b"".join(texts[i:j]) + bytes(32), np.uint8), np.concatenate([[0], ends[:-1]]), ends
        i = j


def _identity(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.array([NO_ID if d is None else d for d in batch.column("doc_id").to_pylist()], np.int64), batch.column("_key").to_numpy()


def removed_spans(docs: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """(docs with _key, rows (doc_id, _key, spans) with the ends of removed runs as pairs of uint32)."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("_key", F.xxhash64("doc_id", "text"))
    parts = 4 * max(1, d.rdd.getNumPartitions())
    gram_at, half = span - GRAM, (span - GRAM + 1) // 2
    half_left, half_right = gram_at - half, gram_at + GRAM + half

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _identity(batch)
            got = []
            for i, _, buf, starts, ends in _texts(batch):
                at, doc, least, most, h = anchors(buf, starts, ends, span)
                lo, hi = starts[doc], ends[doc]
                rows = contexts(buf[: len(buf) - 32], at, lo, hi, span)
                left = np.minimum(at - lo, span - GRAM)
                c = digests(rows, left, np.minimum(hi - at, span), least, most)
                near = digests(rows[:, half_left:gram_at]) >> np.uint64(48), digests(rows[:, gram_at:half_right]) >> np.uint64(48)
                got.append((at - lo, doc + i, least, most, h >> np.uint64(32), c, *near))
            if not got:
                continue
            at, doc, least, most, h, c, before, after = (np.concatenate(v) for v in zip(*got))
            order = np.lexsort((at, keys[doc], ids[doc], c))
            again = np.zeros(len(at), bool)
            again[order[1:]] = c[order[1:]] == c[order[:-1]]
            same_doc = np.zeros(len(at), bool)
            same_doc[order[1:]] = (ids[doc[order[1:]]] == ids[doc[order[:-1]]]) & (keys[doc[order[1:]]] == keys[doc[order[:-1]]]) & (at[order[1:]] == at[order[:-1]])
            later = again & ~same_doc  # a row given twice is one document here
            rows = blobs(SPAN, bucket(keys[doc[later]], parts), ids, keys, doc[later], (at - most)[later], (at - least + span)[later])
            one = ~again
            rows += blobs(ANCHOR, (h[one] % np.uint64(parts)).astype(np.int64), ids, keys, doc[one], at[one], (before.astype(np.int64) << 16 | most << 8 | least)[one], h[one], c[one], after[one])
            if rows:
                yield batch_of(rows)

    met = table(d.mapInArrow(meet, _SCHEMA), "anchors")

    def sort_out(t: pa.Table) -> pa.Table:
        v = unblob(t)
        by_hash = np.argsort(v["h"], kind="stable")
        h = v["h"][by_hash]
        same = h[1:] == h[:-1]
        several = by_hash[(np.concatenate([same, [False]]) | np.concatenate([[False], same]))[: len(h)]]
        v = {k: x[several] for k, x in v.items() if k != "doc"}
        order = np.lexsort((v["x"], v["keys"], v["ids"], v["c"], v["h"]))
        v = {k: x[order] for k, x in v.items()}
        same = v["h"][1:] == v["h"][:-1]
        n = len(v["x"])
        again = np.concatenate([[False], same & (v["c"][1:] == v["c"][:-1])])[:n]
        same_doc = np.concatenate([[False], (v["ids"][1:] == v["ids"][:-1]) & (v["keys"][1:] == v["keys"][:-1]) & (v["x"][1:] == v["x"][:-1])])[:n]
        later = again & ~same_doc  # a row given twice is one document here
        x, y = v["x"].astype(np.int64), v["y"].astype(np.int64)
        most, least = y >> 8 & 255, y & 255
        number = np.arange(len(x))
        rows = blobs(SPAN, bucket(v["keys"][later], parts), v["ids"], v["keys"], number[later], (x - most)[later], (x - least + span)[later])
        group = np.cumsum(np.concatenate([[True], ~same])[:n])
        first = np.flatnonzero(~again)
        want = np.zeros(n, bool)
        for side in (y >> 16, v["r"].astype(np.int64)):  # half of what two contexts have to share, on one side at least
            _, number_of, times = np.unique(group[first] << 16 | side[first], return_inverse=True, return_counts=True)
            want[first] |= times[number_of] > 1
        rows += blobs(WANTED, bucket(v["keys"][want], parts), v["ids"], v["keys"], number[want], x[want], (y & 0xFFFF)[want], v["h"][want])
        return pa.Table.from_batches([batch_of(rows)])

    split = table(met.filter(F.col("kind") == ANCHOR).repartition(parts, "part").groupBy("part").applyInArrow(sort_out, _SCHEMA), "contexts")

    def by_document(t: pa.Table) -> pa.Table:
        v = unblob(t)
        order = np.lexsort((v["x"], v["keys"], v["ids"]))
        ids, keys = v["ids"][order], v["keys"][order]
        edges = np.flatnonzero((ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])) + 1
        items = np.stack([v["x"][order], v["y"][order], v["h"][order] if len(v["h"]) else v["x"][order]], axis=1)
        first = np.concatenate([[0], edges]).astype(int) if len(ids) else np.zeros(0, int)
        return pa.table({"doc_id": ids[first], "_key": keys[first], "items": pa.array([r.tobytes() for r in np.split(items, edges)] if len(ids) else [], pa.binary())})

    grouped = "doc_id long, _key long, items binary"
    wanted = table(split.filter(F.col("kind") == WANTED).repartition(parts, "part").groupBy("part").applyInArrow(by_document, grouped), "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _identity(batch)
            items = batch.column("items").to_pylist()
            got = []
            for i, j, buf, starts, ends in _texts(batch):
                v = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 3) for x in items[i:j]]).astype(np.int64)
                doc = np.repeat(np.arange(j - i), [len(x) // 12 for x in items[i:j]])
                rows = contexts(buf[: len(buf) - 32], v[:, 0] + starts[doc], starts[doc], ends[doc], span)
                got.append((doc + i, v, rows))
            if not got:
                continue
            doc, v, rows = (np.concatenate(x) for x in zip(*got))
            out = blobs(BYTES, v[:, 2] % parts, ids, keys, doc, v[:, 0], v[:, 1], v[:, 2], rows)
            if out:
                yield batch_of(out)

    def joined(small: DataFrame, how: str) -> DataFrame:
        size = small.agg(F.sum(F.length("items") + 40)).first()[0] or 0
        small = F.broadcast(small) if size <= 64 << 20 else small
        return d.join(small, ["doc_id", "_key"], how)

    def compare(t: pa.Table) -> pa.Table:
        v = unblob(t, 2 * span - GRAM)
        order = np.lexsort((v["x"], v["keys"], v["ids"]))
        ids, keys, x, y, c = (v[k][order] for k in ("ids", "keys", "x", "y", "c"))
        twice = np.concatenate([[False], (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1]) & (x[1:] == x[:-1])])[: len(x)]
        ids, keys, x, y, c = (k[~twice] for k in (ids, keys, x.astype(np.int64), y.astype(np.int64), c))
        some, least, most = repeated(c, y & 255, y >> 8, span)
        return pa.Table.from_batches([batch_of(blobs(SPAN, bucket(keys[some], parts), ids, keys, some, x[some] - most, x[some] - least + span))])

    fetched = joined(wanted, "inner").mapInArrow(fetch, _SCHEMA)
    compared = table(fetched.repartition(parts, "part").groupBy("part").applyInArrow(compare, _SCHEMA), "compared")

    def runs(t: pa.Table) -> pa.Table:
        """Overlapping spans of a document become one."""
        docs_ = by_document(t)
        out = []
        for items in docs_.column("items").to_pylist():
            v = np.frombuffer(items, "<u4").reshape(-1, 3).astype(np.int64)
            far = np.maximum.accumulate(v[:, 1])
            cut = np.flatnonzero(v[1:, 0] > far[:-1]) + 1
            out.append(np.stack([v[np.concatenate([[0], cut]), 0], far[np.concatenate([cut - 1, [len(v) - 1]])]], axis=1).astype("<u4").tobytes())
        return pa.table({"doc_id": docs_.column("doc_id"), "_key": docs_.column("_key"), "items": pa.array(out, pa.binary())})

    every = met.unionByName(split).unionByName(compared).filter(F.col("kind") == SPAN)
    spans = table(every.repartition(parts, "part").groupBy("part").applyInArrow(runs, grouped), "spans")
    return joined(spans, "left"), spans


def without_repeats(docs: DataFrame, span: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    marked, _ = removed_spans(docs, span)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, items in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist()):
                b = text.encode("utf-8", "surrogatepass")
                v = np.frombuffer(items or b"", "<u4").reshape(-1, 2).tolist()
                sha, at = hashlib.sha256(), 0
                for lo, hi in v:
                    sha.update(b[at:lo])
                    at = hi
                sha.update(b[at:])
                for col, x in zip(out, (len(b), sum(hi - lo for lo, hi in v), len(v), sha.hexdigest())):
                    col.append(x)
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key"), *[pa.array(x, t) for x, t in zip(out, kinds)]], ["doc_id", "_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = table(marked.mapInArrow(finish, "doc_id long, _key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "kept")
    n = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("n_bytes"))
    later = (n > 1) & (F.col("n_bytes") >= span)
    nothing = hashlib.sha256().hexdigest()
    rows = rows.withColumn("_later", later)
    return rows.select(
        F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "n_bytes",
        F.when(F.col("_later"), F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(F.col("_later"), F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(F.col("_later"), F.lit(nothing)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


@query("op8_bwt_merge")
def bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(load(spark, sf_dir, "documents"))
