"""Run registered queries next to their SQL twins on DuckDB.

    python tests/compare.py [sf_dir] [name part ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if v != v else repr(v)
    if isinstance(v, decimal.Decimal):
        return f"decimal {v}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if v is None:
        return "~"
    return f"{type(v).__name__}:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def difference(df, con, sql) -> str | None:
    """First difference, or nothing when both results are equal."""
    names, got = spark_rows(df)
    wanted_names, wanted = duck_rows(con, sql)
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        return f"rows {len(got)} != {len(wanted)}; {got[:2]} {wanted[:2]}"
    for a, b in zip(got, wanted):
        if a != b:
            return f"{a} != {b}"
    return None


def main():
    from holdfast.catalog import collect
    from holdfast.session import get_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = get_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = collect()
    bad = 0
    for name, run in queries.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        t = time.time()
        try:
            if name in oracles:
                diff = difference(run(spark, sf_dir), con, oracles[name])
                note = "ok" if diff is None else f"DIFF {diff[:600]}"
            else:
                note = f"rows {len(run(spark, sf_dir).collect())}"
                diff = None
        except Exception as e:  # noqa: BLE001
            diff, note = "error", f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += diff is not None
        print(f"{name:40s} {time.time() - t:6.2f}s {note}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
