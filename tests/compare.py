"""Run registered queries in Spark and DuckDB and compare whole results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in records:
        row = []
        for i in order:
            v = r[i]
            row.append(float(repr(v)) if isinstance(v, float) else v)
        out.append(tuple(row))
    return sorted(out, key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    """Return ``(rows, problem or None)``."""
    df = query(spark, sf_dir)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = _rows(cur.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return len(got), f"\n  spark  {g}\n  oracle {w}"
    return len(got), None


def force_shuffles(spark) -> None:
    """Make every join take the path it takes when no side is small."""
    for key in ("spark.sql.autoBroadcastJoinThreshold",
                "spark.sql.adaptive.autoBroadcastJoinThreshold",
                "spark.traceprofile.broadcastBytes"):
        spark.conf.set(key, "-1")


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import build_session

    shuffled = "--shuffled" in argv
    argv = [a for a in argv if not a.startswith("--")]
    sf_dir = argv[0]
    spark = build_session()
    if shuffled:
        force_shuffles(spark)
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failures = 0
    for name in argv[1:] or queries:
        t = time.time()
        try:
            rows, problem = compare(spark, con, sf_dir, name, queries[name], sqls.get(name))
        except Exception as e:  # noqa: BLE001
            rows, problem = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        tag = "rows-only" if name not in sqls else "ok"
        print(f"{name:32s} {rows:8d} {time.time()-t:6.2f}s {'FAIL ' + problem if problem else tag}",
              flush=True)
        failures += problem is not None
    print("failures", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
