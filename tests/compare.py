"""Run catalogue queries and their SQL side by side: python -m tests.compare [sf] [names...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{base}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(pdf) -> list[tuple]:
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.6f}".replace("-0.000000", "0.000000")
        return str(v)

    return sorted(tuple(norm(v) for v in row) for row in pdf[cols].itertuples(index=False))


def main() -> None:
    from citeweave.plans.registry import load
    from citeweave.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    base = f"/root/testdata/{sf}"
    queries, sql = load()
    names = sys.argv[2:] or list(queries)
    spark = build_session(cpus=8)
    con = connect(base)
    bad = 0
    for name in [q for q in queries if any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]:
        t0 = time.time()
        try:
            got = queries[name](spark, base).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"ERR  {name}: {str(e)[:1200] + " ... " + str(e)[-2500:]}", flush=True)
            bad += 1
            continue
        t1 = time.time()
        if name not in sql:
            print(f"rows {name}: {len(got)} rows spark {t1 - t0:.2f}s", flush=True)
            continue
        try:
            want = con.sql(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"SQLERR {name}: {str(e)[:1200] + " ... " + str(e)[-2500:]}", flush=True)
            bad += 1
            continue
        t2 = time.time()
        a, b = canonical(got), (canonical(want) if sorted(got.columns) == sorted(want.columns) else None)
        ok = a == b
        kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns if c in want}
        odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(got)}/{len(want)} rows spark {t1 - t0:.2f}s sql {t2 - t1:.2f}s"
              f"{' kinds ' + str(odd) if odd else ''}", flush=True)
        if not ok:
            bad += 1
            print("   cols", sorted(got.columns), sorted(want.columns))
            if b is not None:
                sa, sb = set(a), set(b)
                print("   spark only", sorted(sa - sb)[:3])
                print("   sql only  ", sorted(sb - sa)[:3])
    print("bad:", bad)


if __name__ == "__main__":
    main()
