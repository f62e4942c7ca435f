"""Run queries next to their oracle statements: ``python -m checks.compare sf0.01 [part]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def kind(v):
    return type(v).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [tuple(plain(r[i]) for i in order) for r in rows]


def difference(df, con, sql) -> str | None:
    """None if both sides agree, else what differs."""
    result = con.execute(sql)
    their_names = [d[0] for d in result.description]
    theirs = rows_of(their_names, result.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(their_names):
        return f"columns {sorted(set(df.columns) ^ set(their_names))}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} against {len(theirs)}"
    for i, name in enumerate(sorted(df.columns)):
        kinds = [{kind(r[i]) for r in side} - {"NoneType"} for side in (ours, theirs)]
        if kinds[0] != kinds[1]:
            return f"type of {name}: {kinds}"

    def key(r):
        return tuple((x is not None, str(type(x)), x) if not isinstance(x, dict)
                     else (True, "", str(x)) for x in r)

    for a, b in zip(sorted(ours, key=key), sorted(theirs, key=key), strict=True):
        if a != b:
            bad = [(n, x, y) for n, x, y in zip(sorted(df.columns), a, b, strict=True) if x != y]
            return f"values {bad[:4]} in {a[:6]}"
    return None


def run_module(run):
    """Short name of the module a query was written in."""
    return run.__wrapped__.__module__.split(".")[-1]


def main():
    folder = f"/root/testdata/{sys.argv[1]}"
    parts = sys.argv[2:] or [""]
    from checks import ORACLES, QUERIES
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for name, run in QUERIES.items():
        if not any(p in (name, run_module(run)) or not p for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in ORACLES:
                found = difference(df, con, ORACLES[name])
            else:
                found = None if df.count() >= 0 else "?"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        mark = "ok" if found is None else f"DIFF {found}"
        print(f"{name:36s} {time.time() - start:6.1f}s "
              f"{'' if name in ORACLES else '(rows only) '}{mark}", flush=True)
        if found:
            bad.append(name)
    print("different:", bad)


if __name__ == "__main__":
    main()
