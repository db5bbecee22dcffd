"""Run registered queries beside their SQL and compare values.

``python tests/compare.py [-v] [--sf FOLDER] [name ...]``; no names means all.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value) -> str:
    if value is None or (isinstance(value, float) and pd.isna(value)) or value is pd.NaT:
        return "NULL"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, float) or type(value).__name__.startswith("float"):
        return str(int(value)) if float(value).is_integer() else repr(float(value))
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return str(value)


def rows(columns: list[str], data) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def mismatch(df, con, sql: str) -> str | None:
    """None when Spark and SQL agree, otherwise what differs."""
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"\n   spark {a}\n   sql   {b}"
    return None


def main() -> int:
    from attestry.session import local_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if "--sf" in args:
        at = args.index("--sf")
        folder = args[at + 1]
        del args[at : at + 2]
    verbose = "-v" in args
    names = [a for a in args if a != "-v"]
    spark = local_session(8)
    con = database(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        start = time.time()
        try:
            if name in oracles:
                problem = mismatch(queries[name](spark, folder), con, oracles[name])
                n = ""
                if verbose:
                    n = f" rows={con.execute(f'select count(*) from ({oracles[name]}) t').fetchall()[0][0]}"
            else:
                problem = None
                n = f" rows-only={queries[name](spark, folder).count()}"
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += problem is not None
        print(f"{'BAD' if problem else 'ok '} {time.time() - start:6.2f}s {name}{n} {problem or ''}", flush=True)
    print(f"{bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
