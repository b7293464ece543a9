"""Run registered queries against their check queries: python tests/oracle.py [--sf DIR] [name...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


KIND = {"int": "INTEGER", "string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, name, run, sql, sf_dir):
    t0 = time.time()
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    msg = f"{name:40s} rows={len(got):7d} spark={t1 - t0:6.2f}s"
    if sql is None:
        return True, msg + " (no check)"
    rel = con.execute(sql)
    desc = [(d[0], str(d[1])) for d in rel.description]
    want = rel.fetchall()
    msg += f" check={time.time() - t1:5.2f}s"
    types = {f.name: KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if types != dict(desc):
        return False, msg + f" SCHEMA {types} != {dict(desc)}"
    a, b = rows_of(df.columns, got), rows_of([d[0] for d in desc], want)
    if a == b:
        return True, msg + (" ok" if got else " ok BUT EMPTY")
    sa, sb = set(a), set(b)
    return False, msg + f" MISMATCH want={len(b)}\n   cols {sorted(df.columns)}\n   only spark {sorted(sa - sb)[:3]}\n   only check {sorted(sb - sa)[:3]}"


def main(argv):
    from trajlytics.queries import catalog
    from trajlytics.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf_dir = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    runs, sqls = catalog.callables(), catalog.checks()
    names = [n for n in runs if not argv or any(n == a or n.startswith(a) for a in argv)]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for n in names:
        try:
            ok, msg = compare(spark, con, n, runs[n], sqls.get(n), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{n:40s} ERROR {type(e).__name__}: {str(e)[:700]}"
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} passed; failed: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
