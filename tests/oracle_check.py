"""Run registered queries against DuckDB: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(df, con, sql: str) -> str | None:
    """None if the same rows, names and types come back, else what differs."""
    columns = sorted(df.columns)
    kinds = [f.dataType.simpleString() for f in df.select(*columns).schema.fields]
    ours = Counter(tuple(r) for r in df.select(*columns).collect())
    listed = ", ".join(f'"{c}"' for c in columns)
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    if sorted(d[0] for d in described) != columns:
        return f"columns {columns} against {sorted(d[0] for d in described)}"
    theirs_kinds = [{d[0]: d[1] for d in described}[c] for c in columns]
    theirs = Counter(con.execute(f"SELECT {listed} FROM ({sql})").fetchall())
    if ours != theirs:
        return (
            f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours "
            f"{str(list((ours - theirs).items())[:2])[:400]}; only theirs {str(list((theirs - ours).items())[:2])[:400]}"
        )
    if [TYPES.get(k) for k in kinds] != theirs_kinds:
        return f"types {dict(zip(columns, kinds))} against {theirs_kinds}"
    return None


if __name__ == "__main__":
    from pairloom.scratch import drop_scratch
    from pairloom.session import local_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    wanted = sys.argv[2:] or list(oracle_sql())
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in wanted:
        began = time.time()
        try:
            problem = compare(queries()[name](spark, sf_dir), con, oracle_sql()[name])
        except Exception as error:  # noqa: BLE001 - reported, and counted as a failure
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        drop_scratch(spark)
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - began:.2f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} match")
