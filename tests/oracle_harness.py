"""Spark-vs-DuckDB comparison used by the tests and by ``python tests/oracle_harness.py``.

Mirrors the driver's gate: row count, column names/types, and an order-free
hash of values with columns sorted by name. Doubles are compared after rounding
to 9 significant digits (the oracle rule rounds aggregates to 6 places).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer() and abs(v) < 2**53:
            return int(v)
        return repr(v) if os.environ.get("ORACLE_STRICT") else float(f"{v:.9g}")
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def digest(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        rows.append(repr(tuple(_norm(x) for x in rec)))
    rows.sort()
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(df), cols, h


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = True) -> dict:
    sys.path.insert(0, ROOT)
    import __spark_entry__ as E

    sql = E.oracle_sql().get(name)
    t0 = time.time()
    sdf = E.queries()[name](spark, sf_dir)
    spd = sdf.toPandas()
    t1 = time.time()
    res = {"name": name, "spark_rows": len(spd), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    opd = con.execute(sql).fetchdf()
    n1, c1, h1 = digest(spd)
    n2, c2, h2 = digest(opd)
    res.update(oracle_rows=n2, cols_match=c1 == c2, hash_match=h1 == h2)
    res["status"] = "ok" if (n1 == n2 and c1 == c2 and h1 == h2) else "MISMATCH"
    if res["status"] != "ok" and verbose:
        res["spark_cols"], res["oracle_cols"] = c1, c2
        if c1 == c2:
            a = spd[c1].sort_values(c1).reset_index(drop=True).head(5)
            b = opd[c2].sort_values(c2).reset_index(drop=True).head(5)
            res["spark_head"] = a.to_dict("records")
            res["oracle_head"] = b.to_dict("records")
    return res


if __name__ == "__main__":
    from vigilia.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    only = sys.argv[1:]
    spark = local_session(8)
    import __spark_entry__ as E

    con = duck(sf)
    bad = 0
    for n in E.queries():
        if only and not any(n.startswith(o) for o in only):
            continue
        try:
            r = compare(spark, n, sf, con)
        except Exception as ex:  # report and continue
            r = {"name": n, "status": "ERROR", "error": str(ex)[:600]}
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    print("FAILED", bad)
