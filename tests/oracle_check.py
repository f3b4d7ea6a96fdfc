"""Compare registered queries with their SQL on DuckDB (also usable by hand).

    python tests/oracle_check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        v = float(v)
        if math.isnan(v):
            return "nan"
        if v == 0:
            return 0.0
        return round(v, 6)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def near(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1.1e-6 + 1e-9 * max(abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(near(x, y) for x, y in zip(a, b))
    return a == b


def compare(name, fn, sql, spark, sf_dir, con):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - t0
    if sql is None:
        return "rows" if rows else "EMPTY", f"{len(rows)} rows", spent
    cur = con.execute(sql)
    d_rows, d_cols = table([c[0] for c in cur.description], cur.fetchall())
    s_rows, s_cols = table(df.columns, rows)
    if s_cols != d_cols:
        return "FAIL", f"columns {s_cols} vs {d_cols}", spent
    if len(s_rows) != len(d_rows):
        return "FAIL", f"rows {len(s_rows)} vs {len(d_rows)}\n   S {s_rows[:3]}\n   D {d_rows[:3]}", spent
    if s_rows == d_rows:
        return "ok", f"{len(rows)} rows", spent
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if not near(a, b)]
    if not bad:
        return "near", f"{len(rows)} rows, last digits differ", spent
    return "FAIL", f"{len(bad)} of {len(rows)} rows differ {s_cols}\n   S {str(bad[0][0])[:600]}\n   D {str(bad[0][1])[:600]}", spent


def main(argv):
    import __spark_entry__ as entry

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2 :]
    sf_dir = f"{DATA}/sf{sf}"
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    failed = 0
    for n in names:
        try:
            status, note, spent = compare(n, queries[n], oracles.get(n), spark, sf_dir, con)
        except Exception as e:  # noqa: BLE001
            status, note, spent = "ERROR", f"{type(e).__name__}: {str(e)[:900]}", 0.0
        failed += status in ("FAIL", "ERROR", "EMPTY")
        print(f"{status:6s} {spent:7.2f}s {n:32s} {note}", flush=True)
    print(f"{len(names)} queries, {failed} bad")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
