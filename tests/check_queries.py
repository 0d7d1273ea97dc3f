"""Runs registered queries against their SQL twins: python tests/check_queries.py [names]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v)
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([_cell(r[i]) for i in order] for r in rows), key=str)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows-only {len(got[1])}"
    cur = con.execute(sql)
    want = normal([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"ROWS {len(got[1])} != {len(want[1])}"
    for g, w in zip(got[1], want[1]):
        if g != w:
            bad = sum(a != b for a, b in zip(got[1], want[1]))
            return f"VALUES {bad}/{len(got[1])} e.g. {g} != {w}"
    return f"ok {len(got[1])}"


def main(names, sf_dir):
    import __spark_entry__ as entry

    from perfgrid.session import local_session

    spark = local_session()
    con = connect(sf_dir)
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or q:
        t = time.time()
        try:
            res = compare(spark, con, name, q[name], o.get(name), sf_dir)
        except Exception as e:
            res = "FAIL " + " ".join(str(e).split())[:900]
        bad += not res.startswith(("ok", "rows-only"))
        print(f"{name:28s} {time.time() - t:6.1f}s {res}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    main(args, sf)
