"""Compare named queries with their check SQL: ``python tests/check.py [--sf DIR] [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else a short account of the difference."""
    a_cols, a = table(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    b_cols, b = table(rel.columns, rel.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} / {b_cols}"
    if a != b:
        sa, sb = set(a), set(b)
        return f"rows {len(a)} / {len(b)}; only spark {str(sorted(sa - sb)[:2])[:500]}; only sql {str(sorted(sb - sa)[:2])[:500]}"
    return None


if __name__ == "__main__":
    from sourceweave.plans import catalogue
    from sourceweave.session import build_session

    args = sys.argv[1:]
    sf = args[args.index("--sf") + 1] if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("--") and a != sf] or list(catalogue.QUERIES)
    if "--plain" in args:  # a session with Spark's own defaults
        from pyspark.sql import SparkSession

        s = SparkSession.builder.master("local[8]").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    else:
        s = build_session("check", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = catalogue.run(n, s, sf)
            out = compare(df, con, catalogue.SQL[n]) if n in catalogue.SQL else f"rows {df.count()} (no SQL)"
            nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map", "decimal")]
            if n in catalogue.SQL and nested:
                out = f"{out or ''} nested columns {nested}"
            rows = "" if out else df.count() if "--rows" in args else ""
        except Exception as e:  # report and go on
            out, rows = f"ERROR {type(e).__name__}: {str(e)[:700]}", ""
        good = out is None or out.endswith("(no SQL)")
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {n} {time.time() - t0:.1f}s {rows} {out or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
