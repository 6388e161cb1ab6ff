"""Run registered queries and their SQL twins side by side.

usage: python check.py [sf_dir] [name-part ...]
"""

import os
import sys
import time

import duckdb

from pointlake.plans import catalogue
from pointlake.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def clean(v):
        if isinstance(v, float):
            return "nan" if v != v else round(v, 6)
        return v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, q, sf_dir):
    """Returns (verdict, spark rows, seconds)."""
    start = time.time()
    df = q.run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    sql = q.oracle()
    if sql is None:
        return "rows-only", got, spent
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {names} {df.columns}", got, spent
    if got == want:
        return "ok", got, spent
    missing = [r for r in want if r not in set(got)][:3] if len(want) < 200000 else []
    extra = [r for r in got if r not in set(want)][:3] if len(got) < 200000 else []
    return f"DIFF spark={len(got)} sql={len(want)} only-sql={missing} only-spark={extra}", got, spent


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    parts = argv[1:]
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("check", f"local[{cpus}]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, q in catalogue().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        try:
            verdict, got, spent = compare(spark, con, q, sf_dir)
        except Exception as e:  # report and go on
            verdict, got, spent = "ERROR " + str(e).split("JVM stacktrace")[0][:600], [], 0.0
        bad += verdict not in ("ok", "rows-only")
        print(f"{name:34s} {len(got):7d} rows {spent:6.2f}s {verdict}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
