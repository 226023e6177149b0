"""Run registered queries against their SQL and report differences."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else (int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, build, sql: str, con, sf_dir: str) -> str | None:
    df = build(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = normal([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)}/{len(got[1])} rows differ, first {bad[0]}" if bad else None


def main():
    sys.path.insert(0, "/root/repo")
    from seriesloom.session import build_session
    from seriesloom.workload import ORACLES, QUERIES

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    conf = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    import os

    if os.environ.get("BLOCK_ROWS"):
        conf["seriesloom.block.rows"] = os.environ["BLOCK_ROWS"]
    spark = build_session("compare", "local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connection(sf_dir)
    failed = 0
    for name, build in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, name, build, ORACLES[name], con, sf_dir)
            else:
                df = build(spark, sf_dir)
                rows = df.count()
                problem = None if rows else "no rows"
                name += f" [{rows} rows only]"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t0:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
