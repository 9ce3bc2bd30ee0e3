"""Run every registered query in Spark and its oracle SQL in DuckDB and
compare (row count, column names, order-insensitive values).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from formbook.sources.fixtures import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
                 "smallint": "SMALLINT", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def spark_type(t: str) -> str:
    if t.startswith("array<"):
        return "LIST"
    if t.startswith("decimal"):
        return t.upper()
    return SPARK_TO_DUCK.get(t, t)


def duck_type(t) -> str:
    t = str(t)
    return "LIST" if t.endswith("[]") else t


def spark_rows(df):
    rows = df.collect()
    return df.columns, [tuple(r) for r in rows]


def compare(spark, con, name, builder, sql, sf_dir):
    t0 = time.time()
    df = builder(spark, sf_dir)
    scols, srows = spark_rows(df)
    t1 = time.time()
    rel = con.sql(sql)
    dtypes = {c: duck_type(t) for c, t in zip(rel.columns, rel.types)}
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    stypes = {f.name: spark_type(f.dataType.simpleString()) for f in df.schema.fields}
    ok_types = all(stypes.get(c) == dtypes.get(c) for c in stypes)
    ok_cols = sorted(scols) == sorted(dcols) and ok_types
    ok_n = len(srows) == len(drows)
    ok_v = ok_cols and rows_key(scols, srows) == rows_key(dcols, drows)
    status = "OK " if (ok_cols and ok_n and ok_v) else "BAD"
    print(f"{status} {name:34s} rows spark={len(srows):6d} duck={len(drows):6d} "
          f"cols={'ok' if ok_cols else 'DIFF'} values={'ok' if ok_v else 'DIFF'} {t1 - t0:.1f}s", flush=True)
    if not ok_cols:
        print("   spark-only:", sorted(set(scols) - set(dcols)), "duck-only:", sorted(set(dcols) - set(scols)),
              "type diffs:", {c: (stypes[c], dtypes.get(c)) for c in stypes if stypes[c] != dtypes.get(c)})
    elif not ok_v:
        a, b = rows_key(scols, srows), rows_key(dcols, drows)
        sa, sb = set(a), set(b)
        print("   cols:", sorted(scols))
        print("   spark-only e.g.:", list(sa - sb)[:2])
        print("   duck-only  e.g.:", list(sb - sa)[:2])
    return status == "OK "


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as entry
    from formbook.session import get_spark
    spark = get_spark()
    qs, orc = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad, missing = [], []
    for name in (names or sorted(qs)):
        if name not in orc:
            df = qs[name](spark, sf_dir)
            n = df.count()
            print(f"--  {name:34s} rows spark={n:6d} (no oracle)")
            missing.append(name)
            continue
        try:
            if not compare(spark, con, name, qs[name], orc[name], sf_dir):
                bad.append(name)
        except Exception as exc:  # report and go on
            print(f"ERR {name}: {type(exc).__name__}: {str(exc)[:400]}")
            bad.append(name)
    print(f"\n{len(qs)} queries, {len(orc)} with oracle, bad={bad}, no-oracle={missing}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
