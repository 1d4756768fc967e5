"""Local correctness gate: run each registered Spark query and its DuckDB
oracle on the same parquet tables and compare (row count, column names,
order-insensitive values with floats rounded).

    python tools/oracle_check.py [sf_dir] [name ...]
"""
from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from tablescope.plans import TABLES, oracle_sql, queries  # noqa: E402
from tablescope.session import local_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v).replace("T", " ")
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if hasattr(v, "as_py"):
        return norm(v.as_py())
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except Exception:
        pass
    return v


def rows_of(cols, tuples):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(t[i]) for i in order) for t in tuples]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if not a.startswith("/")]
    spark = local_session()
    import os
    if os.environ.get("SESSION_TZ"):      # robustness: results must not depend on the session zone
        spark.conf.set("spark.sql.session.timeZone", os.environ["SESSION_TZ"])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, orc = queries(), oracle_sql()
    bad = 0
    for name in sorted(qs):
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:300]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in orc:
            print(f"rows {name}: {len(srows)} rows (no oracle) {dt:.1f}s")
            continue
        try:
            res = con.execute(orc[name])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"FAIL {name}: columns {sorted(cols)} vs {sorted(ocols)}")
            bad += 1
            continue
        a, b = rows_of(cols, srows), rows_of(ocols, orows)
        if len(a) != len(b):
            print(f"FAIL {name}: rows {len(a)} vs {len(b)}")
            bad += 1
            continue
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL {name}: values differ, e.g. {diff}")
            bad += 1
            continue
        print(f"ok   {name}: {len(a)} rows {dt:.1f}s")
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
