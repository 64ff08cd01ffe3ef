"""Compare registered queries with their SQL twins: python tools/check.py SF [name-part ...]."""

from __future__ import annotations

import importlib.util
import pathlib
import sys
import time

import duckdb
import pandas as pd

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "∅"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float):
        return f"{v:.9g}" if v else "0"
    return str(v)


def rows(columns, values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


def kinds(columns, values) -> dict:
    out = {}
    for i, c in enumerate(columns):
        seen = {type(r[i]).__name__ for r in values if r[i] is not None}
        out[c] = seen
    return out


def compare(df, con, sql) -> str | None:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_raw = cur.fetchall()
    got_raw = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got, want = rows(df.columns, got_raw), rows(names, want_raw)
    if len(got) != len(want):
        return f"row count {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"cols {sorted(names)}\n   spark {g}\n   duck  {w}"
    gk, wk = kinds(df.columns, got_raw), kinds(names, want_raw)
    for c in names:
        if gk[c] and wk[c] and gk[c] != wk[c]:
            return f"type of {c}: {gk[c]} != {wk[c]}"
    if not got:
        return "no rows"
    return None


def main() -> int:
    sf, parts = sys.argv[1], sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    from plumbline.session import build_session

    spark = build_session(8)
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p == name or (p.endswith("*") and name.startswith(p[:-1])) for p in parts):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracle:
                msg = compare(df, con, oracle[name])
            else:
                n = len(df.collect())
                msg = None if n else "no rows"
        except Exception as e:  # report and go on to the next query
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        took = time.time() - t
        if msg:
            bad += 1
        print(f"{'FAIL' if msg else 'ok  '} {took:6.2f}s {name}{'' if name in oracle else ' (rows only)'}{': ' + msg if msg else ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
