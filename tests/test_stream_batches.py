"""The continuous merge: many small files from many tasks, statuses without a shuffle for each count."""

import glob
import re

from perfgrid.plans import q_tables as Q
from perfgrid.session import listing_in_few_tasks
from perfgrid.sources import tables as X
from perfgrid.streaming.merge import merged_table, status_table, stream_merge


def test_files_are_written_by_many_tasks(spark, tmp_path):
    """One task wrote all of them, as they are small."""
    texts = spark.createDataFrame([(f"{i:05d}.csv", f"text {i}") for i in range(200)], "name string, value string")
    Q._write_results(texts, f"{tmp_path}/out")
    files = glob.glob(f"{tmp_path}/out/name=*/part-*")
    assert len(files) == 200 and len({re.search(r"part-(\d+)", f)[1] for f in files}) > 8


def test_folders_are_listed_in_few_tasks(spark):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    with listing_in_few_tasks(spark):
        assert int(spark.conf.get(key)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before


def test_statuses_by_dataset(spark):
    cells = [
        ("a", "x", 0.1, 1.0), ("a", "y", 0.2, 1.0), ("a", "x", 0.1, 1.0),  # twice the same
        ("b", "x", 0.1, 1.0), ("b", "x", 0.3, 1.0), ("b", "y", 0.2, 1.0),  # two files differ
        ("c", "x", None, 1.0), ("c", "y", 0.2, 1.0), ("d", "x", 0.1, 1.0),  # a cell and a heading are missing
        ("e", "x", 0.1, 1.0), ("e", "y", 0.1, 1.0), ("e", "z", 0.1, 1.0), ("f", "x", 0.0, 1.0), ("f", "x", -0.0, 1.0), ("f", "y", 0.2, None),
        ("g", "x", 0.1, 1.0), ("g", "y", 0.2, 1.0), ("h", None, 0.2, 1.0), ("h", "x", 0.2, 1.0), ("h", "y", 0.2, 1.0), (None, "x", 0.1, 1.0), (None, "y", 0.1, 1.0),
    ]
    arrived = spark.createDataFrame(cells, X.RESULT)
    done = spark.createDataFrame([("g",), ("q",)], "dataset_id string")
    for heads in (["x", "y"], ["x", "y", "z"], [], [None, "x", "y"]):
        headings = spark.createDataFrame([(h,) for h in heads], "config string")
        want = {r.dataset_id: r.status for r in X.merge_status(done, arrived, headings).collect()}
        datasets = X.by_dataset(arrived)
        got = {r.dataset_id: r.status for r in X.merge_status_by_dataset(done, datasets, headings).collect()}
        assert got == want
        assert sorted(map(str, X.cells_of(datasets).collect())) == sorted(map(str, arrived.distinct().collect()))


def test_batches_know_what_came_before(spark, tmp_path):
    def file(name, error):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(f',"x","y"\nError,{error},0.2\nTime,1.0,2.0\n')

    def run():
        stream_merge(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", files_per_batch=2).awaitTermination()
        return sorted((r.dataset_id, r.status) for r in status_table(spark, f"{tmp_path}/out").collect())

    for i in range(5):
        file(f"{i:05d}.csv", 0.1 * i)
    file("00005.csv", "")
    assert run() == [*((f"{i:05d}", "new") for i in range(5)), ("00005", "missing")]
    merged = merged_table(spark, f"{tmp_path}/out")
    assert merged.count() == 10 and merged.select("dataset_id").distinct().count() == 5
