"""What the corpus operators share: reading, written tables, a query registry."""

from __future__ import annotations

import ctypes
import gc
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

from perfgrid.session import shared_dir, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def table(df: DataFrame, what: str = "table") -> DataFrame:
    """Writes rows to the shared folder and reads them again: cuts the lineage, so a
    lost executor costs one stage and nothing above is computed twice."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Cache(dict):
    """What a Python worker remembers between the tasks of one operator: ``make(key)`` for short keys, at most
    about ``limit`` bytes. Longer keys are made anew each time. Emptied when the worker turns to
    another operator."""

    def __init__(self, owner: str, make: Callable, limit: int = 16 << 20, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.used = make, limit, longest, 0
        me = weakref.ref(self)
        at_leaving(owner, lambda: me() is not None and me().drop())

    def drop(self) -> None:
        self.clear()
        self.used = 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            self.used += 200 + 2 * len(key)
            if self.used > self.limit:
                self.drop()
            self[key] = value
        return value


_HELD: dict[str, list[Callable[[], None]]] = {}
_NOW: list[str] = []


def at_leaving(owner: str, drop: Callable[[], None]) -> None:
    """Registers what a worker forgets when it leaves the operator ``owner``."""
    _HELD.setdefault(owner, []).append(drop)


def enter(owner: str) -> None:
    """Called at the start of a task: drops what other operators left in this worker and gives free
    memory back."""
    if _NOW == [owner]:
        return
    _NOW[:] = [owner]
    for name, drops in _HELD.items():
        if name != owner:
            for drop in drops:
                drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that only few texts are Python strings at a time."""
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)
