"""Run registered queries against their checking SQL in DuckDB and report differences.

    python tools/check.py [--sf 0.01] [name-substring ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sievecrest.catalog import load  # noqa: E402
from sievecrest.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items(), key=lambda kv: str(kv[0]))) + "}"
    if hasattr(v, "asDict"):
        return cell(v.asDict())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


SPARK_KIND = {"bigint": "i8", "int": "i4", "double": "f8", "float": "f4", "string": "s", "boolean": "b", "smallint": "i2"}
DUCK_KIND = {"BIGINT": "i8", "INTEGER": "i4", "DOUBLE": "f8", "FLOAT": "f4", "VARCHAR": "s", "BOOLEAN": "b"}


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--exact", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    queries, sqls = load()
    spark = build_session("check", "8")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = []
    for name, fn in queries.items():
        if args.names and not any((n == name) if args.exact else (n in name) for n in args.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            cols = sorted(df.columns)
            types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            rows = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
            took = time.time() - t0
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: spark {type(e).__name__}: {str(e)[:1500]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
            bad.append(name)
            continue
        if name not in sqls:
            print(f"rows  {name}: {len(rows)} rows {took:.2f}s")
            continue
        try:
            rel = con.execute(sqls[name])
            dcols = [d[0] for d in rel.description]
            dtypes = {d[0]: str(d[1]) for d in rel.description}
            order = sorted(range(len(dcols)), key=lambda i: dcols[i])
            drows = sorted(tuple(cell(r[i]) for i in order) for r in rel.fetchall())
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: duckdb {str(e)[:1500]}")
            bad.append(name)
            continue
        notes = []
        for c in cols:
            a, b = SPARK_KIND.get(types[c]), DUCK_KIND.get(dtypes.get(c, ""))
            if c in dtypes and a and a != b or (a is None and b):
                notes.append(f"{c}: {types[c]} vs {dtypes.get(c)}")
        if sorted(dcols) != cols:
            print(f"DIFF  {name}: columns {cols} vs {sorted(dcols)}")
            bad.append(name)
        elif rows != drows:
            only_s = [r for r in rows if r not in set(drows)][:3]
            only_d = [r for r in drows if r not in set(rows)][:3]
            print(f"DIFF  {name}: {len(rows)} vs {len(drows)} rows\n   cols {cols}\n   spark {only_s}\n   duck  {only_d}"[:3000])
            bad.append(name)
        else:
            print(f"ok    {name}: {len(rows)} rows {took:.2f}s" + (f"  TYPES {notes}" if notes else ""))
    print("bad:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
