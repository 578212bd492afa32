"""Run registered queries next to their SQL and report disagreements.

    python compare.py [--sf DIR] [--only name,name] [--prefix text]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import time

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    return (SparkSession.builder.master(f"local[{cpus}]").appName("fieldlens-compare")
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC").getOrCreate())


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, int):
        return v
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr))


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def check(spark, con, name, q, folder) -> tuple[str, str]:
    start = time.time()
    df = q.run(spark, folder)
    got = df.collect()
    took = time.time() - start
    if q.sql is None:
        return "rows", f"{len(got)} rows, no SQL, {took:.1f}s"
    cur = con.execute(q.sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    gc, gr = normal(df.columns, got)
    wc, wr = normal(cols, want)
    if gc != wc:
        return "FAIL", f"columns {gc} != {wc}"
    types = {str(d[0]): str(d[1]) for d in cur.description}
    odd = [c for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
    if gr != wr:
        diff = [(a, b) for a, b in zip(gr, wr) if a != b][:3]
        return "FAIL", f"rows {len(gr)}/{len(wr)} first differences {diff}"
    return ("ok" if got else "EMPTY"), f"{len(got)} rows, {took:.1f}s" + (f" odd types {odd}" if odd else "")


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    ap.add_argument("--only", default="")
    ap.add_argument("--module", default="")
    a = ap.parse_args()
    from fieldlens.queries import load
    registry = load()
    names = [n for n in a.only.split(",") if n] or [
        n for n, q in registry.items() if q.build.__module__.endswith(a.module)]
    spark, con = session(), duck(a.sf)
    spark.sparkContext.setLogLevel("ERROR")
    tally: dict[str, int] = {}
    for n in names:
        try:
            status, note = check(spark, con, n, registry[n], a.sf)
        except Exception as e:                      # report and go on to the next query
            status, note = "ERROR", f"{type(e).__name__}: {str(e)[:600]}"
        tally[status] = tally.get(status, 0) + 1
        print(f"{status:6} {n}: {note}", flush=True)
    print(tally)


if __name__ == "__main__":
    main()
