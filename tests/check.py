"""Compare registered queries with their SQL on one scale folder.

python tests/check.py [sf_dir] [name ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return str(v)


#: queries whose row order is their result
ORDERED = {"time_order"}


def table(cols, rows, ordered=False):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], out if ordered else sorted(out)


def compare(spark, con, sf, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return True, f"rows-only {len(rows)} rows {took:.1f}s", took
    t0 = time.time()
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    exp = rel.fetchall()
    dt = time.time() - t0
    gc, got = table(df.columns, rows, name in ORDERED)
    ec, want = table(cols, exp, name in ORDERED)
    if gc != ec:
        return False, f"columns {gc} != {ec}", took
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return False, f"{len(got)} vs {len(want)} rows; first differences {bad}", took
    return True, f"{len(rows)} rows {took:.1f}s (sql {dt:.1f}s)", took


def main():
    import __spark_entry__ as E
    from roadwatch.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    if os.environ.get("PLAIN"):   # a session with nothing but the basics set
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
                 .config("spark.checkpoint.dir", os.environ["PLAIN"]).getOrCreate())
    else:
        spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    fails, total = [], 0.0
    for name, fn in qs.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        try:
            ok, msg, took = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as exc:  # report and go on
            ok, msg, took = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
        total += took
        print(("ok   " if ok else "FAIL ") + f"{name}: {msg}", flush=True)
        if not ok:
            fails.append(name)
    print(f"{len(fails)} failures {fails}; {total:.0f}s")


if __name__ == "__main__":
    main()
