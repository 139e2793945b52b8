"""Run queries on Spark and their SQL on DuckDB and compare the rows.

    python -m catalog.check /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

from riskloom.functions.durable import storage

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def oracle_rows(sf_dir: str, statement: str) -> tuple[list[str], list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(statement)
    names = [d[0] for d in cursor.description]
    types = [str(d[1]) for d in cursor.description]
    return names, types, cursor.fetchall()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def as_bag(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


FAMILY = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, sf_dir: str, build, statement: str) -> str:
    """Empty when names, types and rows agree, else what differs."""
    names, types, expected = oracle_rows(sf_dir, statement)
    with storage(spark):
        return _compared(build(spark, sf_dir), names, types, expected)


def _compared(df, names: list[str], types: list[str], expected: list[tuple]) -> str:
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    spark_types = {n: FAMILY.get(t, t) for n, t in df.dtypes}
    wrong = {n: (spark_types[n], t) for n, t in zip(names, types) if spark_types[n] != t}
    if wrong:
        return f"types {wrong}"
    got = as_bag(df.columns, [tuple(r) for r in df.collect()])
    want = as_bag(names, expected)
    if got != want:
        return (f"{sum(got.values())} and {sum(want.values())} rows; only Spark: {list((got - want).items())[:3]}; "
                f"only SQL: {list((want - got).items())[:3]}")
    return "" if want else "no rows"


def main(argv: list[str]) -> int:
    from catalog.session import session
    from catalog.registry import ORACLE, QUERIES

    sf_dir, wanted = argv[0], argv[1:]
    spark = session()
    failed = 0
    for name, build in QUERIES.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in ORACLE:
                problem = compare(spark, sf_dir, build, ORACLE[name])
            else:
                rows = build(spark, sf_dir).count()
                problem = "" if rows else "no rows"
        except Exception as error:  # a failing query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:24} {time.time() - start:6.1f}s {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
