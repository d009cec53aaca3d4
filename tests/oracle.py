"""Side-by-side run of registered queries: Spark against DuckDB on the same parquet files."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def _normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


_KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "date": "DATE", "array<int>": "INTEGER[]", "array<string>": "VARCHAR[]",
         "float": "FLOAT", "array<bigint>": "BIGINT[]"}


def compare(df, con, sql):
    """List of differences between a Spark result and its oracle; empty when they agree."""
    cur = con.execute(sql)
    dn = [d[0] for d in cur.description]
    dt = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    got = [tuple(r) for r in df.collect()]
    problems = []
    if sorted(dn) != sorted(df.columns):
        return [f"columns spark={sorted(df.columns)} duck={sorted(dn)}"]
    for name, kind in df.dtypes:
        if _KIND.get(kind, kind) != dt[name].replace("TIMESTAMP_NS", "TIMESTAMP"):
            problems.append(f"type {name}: spark={kind} duck={dt[name]}")
    a, b = _normal(got, df.columns), _normal(want, dn)
    if len(a) != len(b):
        problems.append(f"rows spark={len(a)} duck={len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        problems.append(f"values {sorted(df.columns)}\n   spark only ({len(sa - sb)}): {sorted(sa - sb)[:3]}"
                        f"\n   duck only ({len(sb - sa)}): {sorted(sb - sa)[:3]}")
    return problems if problems else ([] if a else ["empty result"])


def main():
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from tallyspark.session import local_session

    sf = sys.argv[1]
    names = sys.argv[2:]
    only = {n[1:] for n in names if n.startswith("@")}
    names = [n for n in names if not n.startswith("@")]
    from importlib import import_module
    for m in only:
        names += list(import_module(f"tallyspark.plans.{m}").QUERIES)
    spark = local_session("oracle", 8)
    con = duck(sf)
    oracle = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if names and not any(n == name for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracle:
                res = compare(df, con, oracle[name])
            else:
                n = len(df.collect())
                res = [] if n else ["empty result"]
        except Exception as ex:  # noqa: BLE001
            res = [f"{type(ex).__name__}: {str(ex)[:1500]}"]
        bad += bool(res)
        tag = "ok  " if not res else "FAIL"
        print(f"{tag} {time.time() - t:6.2f}s {name}{'' if name in oracle else ' (rows only)'}", *res, sep="\n   " if res else "", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
