"""Best-fit packing of token sequences by rounds over a shrinking tree.

Documents become pieces of at most ``size`` tokens. Each partition packs its pieces
best-fit decreasing and emits the bins that are nearly full; bins with more room go on
as items to a coarser partitioning, where they are packed again. After each round the smallest
bin left is known, and every bin without room for it is final, as nothing can be added to it. Partitions
are merged only while the members left, counted after each round, fit ``task_members`` a
task; beyond that bins are dealt anew to as many partitions as they need, until a round
saves less than one bin in a hundred. A bin keeps its pieces in an array of at most ``size`` members.

Nulls: a NULL text is empty and still has its end id; a NULL doc_id stays NULL.
Repeated rows are packed each on its own; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfgrid.llm.common import load, query, slices, table
from perfgrid.llm.encoding import encoder, tokenizer_path

_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("tag", pa.int64())])
_BIN = "sequence_id long, fill int, members array<struct<doc_id: long, piece: int, start: long, length: int, ids_crc32: long, tag: long>>"


def cut_pieces(docs: DataFrame, path: str, size: int, end: int | None = 0, tag: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, tag) of every document's ids; ``tag``
    names a long column that tells rows of one doc_id apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        tail = np.array([] if end is None else [end], enc.dtype).tobytes()
        for batch in (part for whole in batches for part in slices(whole)):
            out: list[list] = [[] for _ in range(6)]
            for d, t, g in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "tag"))):
                ids = np.frombuffer(enc.raw(t) + tail, enc.dtype).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    for col, v in zip(out, (d, piece, at, len(part), zlib.crc32(part), g)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(col, _MEMBER[i].type) for i, col in enumerate(out)], [_MEMBER[i].name for i in range(6)])

    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), (F.col(tag) if tag else F.lit(0)).cast("long").alias("tag"))
    return d.mapInArrow(cut, "doc_id long, piece int, start long, length int, ids_crc32 long, tag long")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers of each bin. Bins wait by the room they have left; a
    bit set of the rooms in use finds the tightest one that is wide enough."""
    bins: list[list[int]] = []
    waiting: dict[int, list[int]] = {}
    rooms = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        left = room - need
        if left:
            waiting.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


def pack_bins(pieces: DataFrame, size: int, full: float = 0.995, fan_in: int = 8, task_members: int = 200_000) -> DataFrame:
    """Rows of pieces with sequence_id and offset. ``full`` is the fill at which a bin is
    final; ``fan_in`` partitions are merged from round to round, of at most about
    ``task_members`` members each."""
    spark = pieces.sparkSession
    member = F.struct(*[f.name for f in _MEMBER])

    def packed(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = [x for batch in batches for x in zip(batch.column("fill").to_pylist(), batch.column("members"))]
            base = (level << 56) | (TaskContext.get().partitionId() << 28)
            done = best_fit([x[0] for x in items], size)
            for at in range(0, len(done), 4096):
                rows: list[list] = [[], [], []]
                for n, b in enumerate(done[at : at + 4096], at):
                    rows[0].append(base + n)
                    rows[1].append(sum(items[i][0] for i in b))
                    rows[2].append([m for i in b for m in items[i][1].as_py()])
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.list_(_MEMBER))], ["sequence_id", "fill", "members"])

        return run

    full_at = int(size * full)
    bins = table(pieces.select(F.lit(0).cast("long").alias("sequence_id"), F.col("length").alias("fill"), F.array(member).alias("members")), "pieces")
    parts = max(1, bins.rdd.getNumPartitions())
    done, level, count, redealt = [], 1, None, False
    while True:
        spread = bins if level == 1 else bins.repartition(parts) if redealt else bins.coalesce(parts)
        packing = table(spread.mapInArrow(packed(level), _BIN), "bins")
        left = packing.filter(F.col("fill") < full_at)
        rest = left.agg(F.min("fill").alias("least"), F.count(F.lit(1)).alias("n")).first()
        final = F.col("fill") >= full_at if rest.least is None else F.col("fill") > min(full_at - 1, size - rest.least)
        left = packing.filter(~final)
        rest = left.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("members")).first()
        stuck = redealt and count is not None and rest.n > 0.99 * count
        if rest.n == 0 or parts == 1 and level > 1 or stuck:
            done.append(packing)
            break
        done.append(packing.filter(final))
        need = -(-int(rest.members) // task_members)
        redealt, count = need > parts // fan_in, rest.n
        parts, level, bins = max(1, parts // fan_in, need), level + 1, left
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.mapInArrow(_placed, _PLACED)


_PLACED = "doc_id long, piece int, start long, length int, ids_crc32 long, tag long, sequence_id long, offset long"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each member of a bin, with its place there."""
    for batch in batches:
        members, seq = batch.column("members"), batch.column("sequence_id").to_numpy()
        flat, counts = members.flatten(), np.diff(members.offsets.to_numpy())
        lengths = flat.field("length").to_numpy().astype(np.int64)
        ends = np.cumsum(lengths)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        at = ends - lengths
        base = np.repeat(at[first] if len(at) else at, counts)
        cols = [flat.field(i) for i in range(6)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.repeat(seq, counts)), pa.array(at - base)], [f.name for f in _MEMBER] + ["sequence_id", "offset"])


@query("op6_best_fit")
def best_fit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_pieces(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048)
    return pack_bins(pieces, 2048).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
