"""Token-id files: fixed-width bit packing with block offsets.

Ids take the fewest bits the vocabulary allows. Sixty-four ids fill exactly ``width``
64-bit words, so groups of 64 are packed and unpacked by a few array operations, and
the words of any id are found by arithmetic. A file holds, little-endian:

    8 bytes magic | width, block size, documents, ids, blocks (uint64 each)
    doc ids (int64, the smallest value for NULL) | first id of each document, and the end (uint64)
    byte offset of each block's first word, and the end (uint64) | packed words

Nulls: a NULL text is empty; a NULL doc_id sorts first. Repeated rows are documents of
their own, ordered by text hash. An empty table writes no file and returns no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfgrid.llm.common import load, new_folder, query, table
from perfgrid.llm.encoding import encoder, tokenizer_path

MAGIC = b"PGBITS01"
BLOCK = 4096
NO_ID = np.iinfo(np.int64).min


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """uint64 words; a last incomplete group of 64 is padded with zeros."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros(groups * 64, np.uint64)
    lanes[: len(ids)] = ids
    lanes = np.ascontiguousarray(lanes.reshape(groups, 64).T)
    words = np.zeros((width, groups), np.uint64)
    for j in range(64):
        w, shift = divmod(j * width, 64)
        words[w] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            words[w + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).ravel()


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """All ids of whole groups, in order (uint32)."""
    cols = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, cols.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        w, shift = divmod(j * width, 64)
        got = cols[w] >> np.uint64(shift)
        if shift + width > 64:
            got = got | (cols[w + 1] << np.uint64(64 - shift))
        out[j] = got & mask
    return np.ascontiguousarray(out.T).ravel()


def file_bytes(doc_ids: np.ndarray, starts: np.ndarray, chunks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """The parts of one file; ``chunks`` are the ids, in pieces."""
    width = max(1, int(vocabulary - 1).bit_length())
    ids = np.concatenate(chunks) if chunks else np.zeros(0, np.uint16)
    words = [pack(ids[i : i + 64 * BLOCK], width) for i in range(0, len(ids), 64 * BLOCK)]
    blocks = -(-len(ids) // BLOCK)
    at = np.minimum(np.arange(blocks + 1, dtype=np.uint64) * np.uint64(BLOCK // 64 * width * 8), np.uint64(sum(w.nbytes for w in words)))
    head = np.array([width, BLOCK, len(doc_ids), len(ids), blocks], "<u8")
    return [MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes(), at.astype("<u8").tobytes(), *[w.astype("<u8").tobytes() for w in words]]


class PackedFile:
    """Reads one file; ``ids(a, b)`` touches only the blocks that hold them."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a packed id file")
        width, self.block, docs, self.n, blocks = (int(x) for x in np.frombuffer(data, "<u8", 5, 8))
        self.width, at = width, 48
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at := at + 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * (docs + 1))
        self.data, self.base = data, at + 8 * (blocks + 1)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        lo, hi = int(self.offsets[first]), int(self.offsets[last + 1])
        words = np.frombuffer(self.data, "<u8", (hi - lo) // 8, self.base + lo)
        return unpack(words, self.width)[a - first * self.block : b - first * self.block]


def _fs(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_ids(docs: DataFrame, path: str, folder: str, end: int | None = 0) -> DataFrame:
    """Encodes texts in ascending doc_id order into files below ``folder``. Returns the
    written manifest: part (ascending with doc_id), file, n_docs, n_ids.

    A task writes its file under a name of its attempt and then moves it to its place, so
    a task that is run again leaves the same file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ctx = encoder(path), TaskContext.get()
        part = ctx.partitionId()
        chunks, lengths, doc_ids, tail = [], [], [], [] if end is None else [end]
        tail = np.array(tail, enc.dtype).tobytes()
        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.frombuffer(enc.raw(t) + tail, enc.dtype)
                chunks.append(ids)
                lengths.append(len(ids))
                doc_ids.append(NO_ID if d is None else d)
        if not doc_ids:
            return
        starts = np.concatenate([[0], np.cumsum(lengths)])
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        name, tmp = f"{base}/ids-{part:06d}.bin", f"{base}/_try-{part:06d}-{ctx.taskAttemptId()}"
        with fs.open_output_stream(tmp) as out:
            for piece in file_bytes(np.array(doc_ids, np.int64), starts, chunks, enc.size):
                out.write(piece)
        fs.move(tmp, name)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/ids-{part:06d}.bin"], "n_docs": [len(doc_ids)], "n_ids": [int(starts[-1])]})

    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    ranged = d.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return table(ranged.mapInArrow(write, "part long, file string, n_docs long, n_ids long"), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Rows of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                fs, at = _fs(file)
                with fs.open_input_file(at) as f:
                    packed = PackedFile(f.read())
                s, out = packed.starts, []
                step = 2048
                for i in range(0, len(s) - 1, step):
                    j = min(i + step, len(s) - 1)
                    ids = packed.ids(int(s[i]), int(s[j])).astype("<u4")
                    out += [zlib.crc32(ids[s[k] - s[i] : s[k + 1] - s[i]]) for k in range(i, j)]
                ids = pa.array([None if x == NO_ID else x for x in packed.doc_ids.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(s[:-1] + base), pa.array(np.diff(s)), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    m = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return m.repartition(max(1, m.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op5_packed_ids")
def packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return read_ids(write_ids(docs, tokenizer_path("byte_bpe_50k.json"), new_folder(spark, "ids")))
