"""Run registered queries against their SQL check: python tests/compare.py [sf] [name ...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r)
    return sorted((tuple(r[i] for i in order) for r in rows), key=key)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a text that says what differs; without SQL there must be rows."""
    df = fn(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if mine else "no rows"
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    spark_names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for n, t in df.dtypes:
        if spark_names.get(t, t) != types[n]:
            return f"type of {n}: {t} != {types[n]}"
    theirs = _rows(rel.columns, rel.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} rows differ, columns {sorted(df.columns)}, first: {bad[0]}"
    return None


def main():
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    wanted = sys.argv[2:]
    spark, con, checks, failed = local_session(8), connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            problem = compare(spark, con, name, fn, checks.get(name), sf_dir)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        kind = "sql " if name in checks else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - started:6.1f}s {name} {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
