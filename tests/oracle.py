"""Side-by-side run of the registered queries and their DuckDB statements.

``python tests/oracle.py [folder] [name part ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(repr(value))
    return value.item() if hasattr(value, "item") else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(df, con, sql):
    """None when both sides agree, else what differs."""
    rel = con.sql(sql)
    types = {n: SAME.get(t, t) for n, t in df.dtypes}
    other = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    if types != other:
        return f"schema: {sorted(set(types.items()) ^ set(other.items()))}"
    cols, left = table(df.columns, [tuple(r) for r in df.collect()])
    _, right = table(rel.columns, rel.fetchall())
    if len(left) != len(right):
        extra, missing = sorted(set(left) - set(right), key=repr), sorted(set(right) - set(left), key=repr)
        return f"rows {cols}: {len(left)} vs {len(right)}; only here {extra[:2]}; only there {missing[:2]}"
    for a, b in zip(left, right):
        if a != b:
            return f"values {cols}: {a} vs {b}"[:1500]
    return "EMPTY" if not left else None


def main():
    from doctables.session import get_session
    from doctables.workload import load_all
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = get_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    con, bad, n = connect(folder), [], 0
    for name, e in load_all().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        n += 1
        start = time.time()
        try:
            df = e.run(spark, folder)
            result = compare(df, con, e.sql) if e.sql else f"rows only: {df.count()}"
        except Exception as err:  # noqa: BLE001
            result = "ERROR " + str(err)[:1200] if not os.environ.get("TRACE") else traceback.format_exc()
        good = result is None or result.startswith("rows only")
        if not good:
            bad.append(name)
        print(f"{'ok ' if good else 'BAD'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print(f"{n - len(bad)}/{n} agree; bad: {bad}")


if __name__ == "__main__":
    main()
