"""Compare registered queries with their SQL twins: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    import decimal
    import math

    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        v = round(v, 6)
        return v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con) -> str:
    got_c, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    exp_c, exp = rows_of([d[0] for d in res.description], res.fetchall())
    if got_c != exp_c:
        return f"columns {got_c} != {exp_c}"
    if len(got) != len(exp):
        return f"rows {len(got)} != {len(exp)}; got {got[:2]} want {exp[:2]}"
    if not got:
        return "EMPTY"
    bad = [(g, e) for g, e in zip(got, exp) if g != e]
    if bad:
        return f"{len(bad)}/{len(got)} differ; cols {got_c}; got {bad[0][0]} want {bad[0][1]}"
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from strideframe.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    qs, orc = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not args or any(n == a or n.startswith(a) for a in args)]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf)
            if n in orc:
                msg = compare(df, orc[n], con)
            else:
                msg = f"rows only: {df.count()}"
                msg = "EMPTY" if msg.endswith(" 0") else "" + msg
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:500]}"
        ok = msg == "" or msg.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {msg}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
