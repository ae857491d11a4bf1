"""Compare registered queries with their SQL in DuckDB: python tests/check_oracle.py [sf] [name…]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"rows only: {len(got)} rows, {took:.1f}s"
    start = time.time()
    result = con.sql(sql)
    want = rows_of(result.columns, result.fetchall())
    took2 = time.time() - start
    note = f"{len(got)} rows, spark {took:.1f}s, sql {took2:.1f}s"
    if sorted(df.columns) != sorted(result.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(result.columns)}"
    if got == want:
        from pyspark.sql import types as T

        kinds = dict(zip(result.columns, [str(x) for x in result.types], strict=True))
        for f in df.schema.fields:
            ok = {
                "BIGINT": T.LongType, "INTEGER": T.IntegerType, "VARCHAR": T.StringType,
                "DOUBLE": T.DoubleType, "BOOLEAN": T.BooleanType,
            }.get(kinds[f.name])
            if ok is None or not isinstance(f.dataType, ok):
                note += f" [type {f.name}: {f.dataType.simpleString()} vs {kinds[f.name]}]"
        return True, note
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return False, f"{note} (sql {len(want)} rows)\n   spark only: {only_got}\n   sql only: {only_want}"


def main() -> int:
    import __spark_entry__ as contract
    from corpusq import build_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    oracle = contract.oracle_sql()
    bad = 0
    for name, fn in contract.queries().items():
        if args[1:] and not any(name.startswith(a) for a in args[1:]):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, fn, oracle.get(name))
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
