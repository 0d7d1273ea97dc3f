"""Blocks take little room on disk, and rows that are read several times are stored once."""

import numpy as np
from pyspark.sql import functions as F

from perfgrid.operators import blocks as B
from perfgrid.session import stored


def test_values_are_compressed(spark):
    """Each value took eight bytes."""
    rng = np.random.default_rng(3)
    rows = [(int(i % 2), "ab"[int(rng.integers(2))], int(rng.integers(5)), int(i), *(float(v) for v in rng.integers(0, 2, 6)), float(rng.normal()) if i % 9 else None) for i in range(3000)]
    cols = [*(f"c{i}" for i in range(6)), "v"]
    t = spark.createDataFrame(rows, "dataset_id int, label string, fold int, key long, " + ", ".join(f"{c} double" for c in cols))
    b = B.pack(t, ["dataset_id"], "label", cols[:6], F.col("key"), 5, block_rows=500, edges=False)
    sizes = b.frame.select(F.sum(F.length("x")).alias("x"), F.sum(F.length("key")).alias("key")).first()
    assert sizes.key == 8 * 3000 and sizes.x < 8 * 6 * 3000 / 4
    b = B.pack(t, ["dataset_id"], "label", cols, F.col("key"), 5, block_rows=500, edges=False)
    of = {r[3]: r for r in rows}
    for row in b.frame.collect():
        data = B.Data(row.asDict(), 7)
        for x, y, fold, key in zip(data.x, data.y, data.fold, data.key):
            want = of[int(key)]
            assert np.array_equal(x, [np.nan if v is None else v for v in want[4:]], equal_nan=True) and ("ab"[y], fold) == want[1:3]


def test_values_that_do_not_shrink_and_empty_blocks():
    raw = np.random.default_rng(1).integers(0, 2**62, 100).tobytes()
    for some in (raw, b"", raw[:8], bytes(8000)):
        assert B._wide(B._narrow(some), len(some)) == some
    assert len(B._narrow(raw)) <= len(raw)


def test_stored_rows_come_back(spark):
    t = spark.createDataFrame([(1, "a", bytes(3), None), (None, None, None, 0.5)], "a int, b string, c binary, d double")
    back = stored(t, "test")
    assert sorted(map(str, back.collect())) == sorted(map(str, t.collect())) and back.columns == t.columns
