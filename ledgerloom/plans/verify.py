"""Local stand-in for the driver's correctness gate.

Runs a registered Spark job and its oracle SQL on the same folder and
compares row count, column names and an order-insensitive hash of values.
Usage: ``python -m ledgerloom.plans.verify [sf_dir] [key ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys
import time

from ledgerloom.sources.tables import table_path

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v else "NULL"
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    return str(v)


_TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "TINYINT",
             "string": "VARCHAR", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
             "timestamp": "TIMESTAMP WITH TIME ZONE", "boolean": "BOOLEAN", "double": "DOUBLE",
             "float": "FLOAT"}


def _duck_type(spark_type: str) -> str:
    if spark_type.startswith("decimal"):
        return spark_type.upper()
    return _TYPE_MAP.get(spark_type, spark_type.upper())


def digest(columns, rows) -> tuple[list[str], int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return cols, len(lines), h


def compare(spark, sf_dir: str, keys=None, verbose=True) -> dict:
    from ledgerloom.plans.registry import oracle_sql, queries
    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    out = {}
    for key in keys or list(qs):
        rec = {}
        try:
            t0 = time.time()
            df = qs[key](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            rec["spark_s"] = round(time.time() - t0, 2)
            s_cols, s_n, s_h = digest(df.columns, rows)
            rec.update(rows=s_n)
            if key in sqls:
                rel = con.sql(sqls[key])
                d_cols_raw = list(rel.columns)
                d_types = dict(zip(d_cols_raw, [str(t) for t in rel.types]))
                d_rows = rel.fetchall()
                s_types = {f.name: _duck_type(f.dataType.simpleString()) for f in df.schema.fields}
                bad_types = {c: (s_types.get(c), d_types.get(c)) for c in d_types
                             if s_types.get(c) != d_types.get(c)}
                if bad_types:
                    rec["type_diff"] = bad_types
                d_cols, d_n, d_h = digest(d_cols_raw, d_rows)
                rec.update(oracle_rows=d_n, cols_match=s_cols == d_cols, match=(s_cols == d_cols and s_h == d_h))
                if not rec["match"]:
                    rec["spark_cols"], rec["oracle_cols"] = s_cols, d_cols
            else:
                rec["match"] = None
        except Exception as e:  # noqa: BLE001 — report and continue
            rec["error"] = f"{type(e).__name__}: {str(e)[:400]}"
        out[key] = rec
        if verbose:
            print(key, rec, flush=True)
    return out


def main(argv):
    from ledgerloom.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:] or None
    spark = build_session()
    res = compare(spark, sf_dir, keys)
    bad = [k for k, v in res.items() if v.get("match") is False or "error" in v]
    print("MISMATCH/ERROR:", bad)
    print(f"{sum(1 for v in res.values() if v.get('match'))} match, "
          f"{sum(1 for v in res.values() if v.get('match') is None and 'error' not in v)} rows-only, {len(bad)} bad")


if __name__ == "__main__":
    main(sys.argv)
