"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle_check.py [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from speechframe.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if value is None:
        return "~null"
    return f"{type(value).__name__}:{value}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(normal(r[i]) for i in order) for r in data)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_columns, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"{len(got)} rows, no SQL"
    cursor = con.execute(sql)
    want_columns, want = rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"FAIL columns {got_columns} != {want_columns}"
    if got != want:
        extra = sorted(set(got) - set(want))[:2]
        missing = sorted(set(want) - set(got))[:2]
        return f"FAIL {len(got)} rows vs {len(want)}; only here {extra}; only SQL {missing}"
    return f"ok {len(got)} rows"


def main(names: list[str]) -> int:
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("8")
    con = connect(sf_dir)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            result = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            result = f"FAIL {type(error).__name__}: {str(error)[:1500]}"
        bad += result.startswith("FAIL")
        print(f"{name:24s} {time.time() - started:6.2f}s {result}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
