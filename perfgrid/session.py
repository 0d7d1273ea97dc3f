"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("perfgrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only when the cluster names none and the session is local does a fresh
    temporary folder stand in.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    chosen = getattr(shared_dir, "_local", None)
    if chosen is None:
        chosen = tempfile.mkdtemp(prefix="perfgrid-")
        shared_dir._local = chosen
    return chosen


def cut(df: DataFrame, wide: bool = False) -> DataFrame:
    """Reliable checkpoint: the result survives lost executors and has no lineage.

    ``wide`` keeps the partition count of the last shuffle, for rows that feed much
    heavier steps than the shuffle which made them.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merge)
    if wide:
        spark.conf.set(merge, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(merge, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to a new folder below the shared one and read back: for rows that are read more than once, in columns and compressed,
    which takes a fraction of the disk of a checkpoint."""
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/perfgrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def broadcast_checked(df: DataFrame, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Broadcast hint for a materialized table whose counted rows fit the limit; a
    longer one is joined by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def attach(df: DataFrame, stats: DataFrame, keys: list[str], row_bytes: int, how: str = "inner") -> DataFrame:
    """Joins grouped statistics to rows. The statistics are materialized and, when
    their counted size allows, broadcast: rows are then not shuffled by group, so a
    group that holds most of them stays spread out."""
    return df.join(broadcast_checked(cut(stats), row_bytes), keys, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def listing_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by some tasks a core. By default each of thousands of folders with one file is a task of its own, which
    costs more than its listing."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Adds this package to the session's Python files once, so that tasks on any
    executor can import it."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(ship, "_done", None) == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="perfgrid-"), "perfgrid.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    ship._done = sc.applicationId
