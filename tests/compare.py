"""Run queries and their SQL side by side: python tests/compare.py [--sf DIR] [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def rows_of(rows: list, columns: list[str]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fixed = lambda x: None if isinstance(x, float) and x != x else 0.0 if x == 0 and isinstance(x, float) else x
    return sorted(repr([fixed(r[i]) for i in order]) for r in rows)


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def difference(spark, con: duckdb.DuckDBPyConnection, query, sql: str, sf_dir: str) -> str:
    """Empty if the query and the SQL agree in columns and rows."""
    df = query(spark, sf_dir)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    mine, theirs = rows_of(df.collect(), df.columns), rows_of(found.fetchall(), columns)
    if mine == theirs:
        return ""
    a, b = [x for x in mine if x not in set(theirs)], [x for x in theirs if x not in set(mine)]
    return f"{len(mine)} and {len(theirs)} rows, {len(a)} and {len(b)} apart: {a[:2]} {b[:2]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    sf_dir = args.pop(1) if args[:1] == ["--sf"] and args.pop(0) and False else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sqls = oracle(sf_dir), entry.oracle_sql()
    for name, query in entry.queries().items():
        if (args and not any(a in name for a in args)) or (not args and name.startswith(("op", "pipeline"))):
            continue
        began = time.time()
        try:
            said = difference(spark, con, query, sqls[name], sf_dir) if name in sqls else f"{query(spark, sf_dir).count()} rows, no SQL"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
