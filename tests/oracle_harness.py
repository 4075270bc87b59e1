"""Local twin of the driver's correctness gate.

Runs ``queries()[k]`` on Spark and ``oracle_sql()[k]`` on DuckDB over the same
parquet tables and compares row count, column names and an order-insensitive
hash of the values (doubles rounded to 6 places).

    python tests/oracle_harness.py [sf_dir] [key ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return repr(0.0 if r == 0 else r)
    if isinstance(v, bool):
        return str(int(v))
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _spark_kind(t) -> str:
    n = t.simpleString()
    return {"int": "int32", "bigint": "int64", "double": "float64", "string": "string",
            "boolean": "bool", "float": "float32", "smallint": "int16", "tinyint": "int8"}.get(n, n)


def _duck_kind(t: str) -> str:
    t = t.upper()
    return {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "VARCHAR": "string",
            "BOOLEAN": "bool", "FLOAT": "float32", "SMALLINT": "int16", "TINYINT": "int8",
            "NUMBER": "float64", "STRING": "string", "DATETIME": "timestamp"}.get(t, t.lower())


def digest(columns, rows) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(lines), h


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = {"key": key, "spark_s": round(t1 - t0, 2)}
    if sql is None:
        res.update(rows=len(srows), status="rows-only")
        return res
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["duck_s"] = round(time.time() - t1, 2)
    stypes = {f.name: _spark_kind(f.dataType) for f in sdf.schema.fields}
    dtypes_ = {d[0]: _duck_kind(str(d[1])) for d in cur.description}
    tdiff = {c: (stypes.get(c), dtypes_.get(c)) for c in stypes if stypes.get(c) != dtypes_.get(c)}
    if tdiff:
        res["types"] = tdiff
    sn, sh = digest(scols, srows)
    dn, dh = digest(dcols, drows)
    ok = sorted(scols) == sorted(dcols) and sn == dn and sh == dh
    res.update(rows=sn, duck_rows=dn, status="ok" if ok else "MISMATCH")
    if sorted(scols) != sorted(dcols):
        res["cols"] = (sorted(scols), sorted(dcols))
    if not ok and sn == dn and sorted(scols) == sorted(dcols):
        order_s = sorted(range(len(scols)), key=lambda i: scols[i])
        order_d = sorted(range(len(dcols)), key=lambda i: dcols[i])
        a = sorted("|".join(_norm(r[i]) for i in order_s) for r in srows)
        b = sorted("|".join(_norm(r[i]) for i in order_d) for r in drows)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["diff"] = diff
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from claimlens.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for k in keys or list(qs):
        try:
            r = compare(spark, con, k, qs[k], sqls.get(k), sf_dir)
        except Exception as exc:  # noqa: BLE001
            r = {"key": k, "status": "ERROR", "error": repr(exc)[:600]}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"done: {len(keys or qs)} keys, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
