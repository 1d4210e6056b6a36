"""Run queries next to their SQL in DuckDB and compare rows: python tests/compare.py [sf_dir] [name…]"""

from __future__ import annotations

import math
import pathlib
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def differences(spark_df, con, sql: str) -> str | None:
    """None when both sides hold the same multiset of rows, else a short report."""
    columns = sorted(spark_df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns differ: {columns} / {sorted(names)}"
    types = dict(zip(names, [str(d[1]) for d in result.description]))
    unlike = {c: (t, types[c]) for c, t in spark_df.dtypes if TYPE_NAMES.get(t, t) != types[c]}
    if unlike:
        return f"types differ: {unlike}"
    order = [names.index(c) for c in columns]
    theirs = [tuple(normal(row[i]) for i in order) for row in result.fetchall()]
    ours = [tuple(normal(row[c]) for c in columns) for row in spark_df.select(*[f"`{c}`" for c in columns]).collect()]
    if len(ours) != len(theirs):
        return f"row counts differ: {len(ours)} / {len(theirs)}"

    def key(row):
        return tuple((v is None, str(v)) for v in row)

    ours.sort(key=key)
    theirs.sort(key=key)
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        a, b = bad[0]
        cells = {c: (x, y) for c, x, y in zip(columns, a, b) if x != y}
        return f"{len(bad)} of {len(ours)} rows differ, first: {cells}"
    return None


def main() -> int:
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = contract.queries(), contract.oracle_sql()
    failed = []
    con = duck(sf_dir)
    for name in args or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                report = differences(df, con, oracle[name])
            else:
                rows = df.collect()
                report = None if rows else "no rows"
        except Exception as error:  # a report line per query, whatever went wrong
            report = f"{type(error).__name__}: {str(error)[:600]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        state = "ok  " if report is None else "FAIL"
        print(f"{state} {time.time() - start:6.2f}s {name}{' (rows only)' if name not in oracle else ''} {report or ''}", flush=True)
        if report is not None:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
