"""Run queries beside their SQL twins and report differences.

    python tools/check.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import importlib
import math
import sys
import time

import duckdb

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def kind(v):
    import datetime as dt
    import decimal
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, decimal.Decimal):
        return "decimal"
    if isinstance(v, float):
        return "float"
    if isinstance(v, dt.datetime):
        return "ts"
    if isinstance(v, dt.date):
        return "date"
    return type(v).__name__


def norm(v):
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return v


def key(row):
    return tuple((v is None, str(type(v)), repr(v)) for v in row)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    base = f"/root/testdata/{args.sf}"
    entry = importlib.import_module("__spark_entry__")
    from tidemark.session import local_session
    spark = local_session()
    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    names = [n for n in qs if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, base)
            cols = sorted(df.columns)
            got = [tuple(norm(v) for v in r) for r in df.select(*cols).collect()]
        except Exception as e:
            print(f"FAIL {n}: spark: {str(e)[:1500]}")
            bad += 1
            continue
        t1 = time.time()
        if n not in sqls:
            print(f"rows {n}: {len(got)} rows {t1 - t0:.1f}s (no twin)")
            continue
        try:
            cur = con.execute(sqls[n])
            dcols = [d[0] for d in cur.description]
            idx = sorted(range(len(dcols)), key=lambda i: dcols[i])
            want = [tuple(norm(r[i]) for i in idx) for r in cur.fetchall()]
        except Exception as e:
            print(f"FAIL {n}: duckdb: {str(e)[:700]}")
            bad += 1
            continue
        t2 = time.time()
        if cols != sorted(dcols):
            print(f"FAIL {n}: columns spark-only {set(cols) - set(dcols)} duck-only {set(dcols) - set(cols)}")
            bad += 1
            continue
        gs, ws = sorted(got, key=key), sorted(want, key=key)
        types = [c for i, c in enumerate(cols)
                 if len({kind(r[i]) for r in got[:2000] if r[i] is not None} | {kind(r[i]) for r in want[:2000] if r[i] is not None}) > 1]
        nans = [c for i, c in enumerate(cols) if any(isinstance(r[i], float) and not math.isfinite(r[i]) for r in got + want)]
        if gs == ws and not types and not nans:
            print(f"ok   {n}: {len(got)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s{'  EMPTY' if not got else ''}")
        else:
            bad += 1
            print(f"FAIL {n}: rows {len(got)} vs {len(want)}; type clash {types}; non-finite {nans}")
            if len(gs) == len(ws):
                diff = {}
                for a, w in zip(gs, ws):
                    for i, c in enumerate(cols):
                        if a[i] != w[i]:
                            diff.setdefault(c, []).append((a[i], w[i]))
                for c, d in list(diff.items())[:6]:
                    print("    ", c, len(d), d[:3])
            else:
                print("     spark-only", [r for r in got if r not in set(map(lambda x: x, want))][:2] if len(got) < 3000 else "")
                print("     duck-only", [r for r in want if r not in set(got)][:2] if len(got) < 3000 else "")
        sys.stdout.flush()
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
