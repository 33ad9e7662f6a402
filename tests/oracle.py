"""Runs queries beside their SQL in DuckDB; used by the tests and from the command line.

    python tests/oracle.py FOLDER [NAME...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(f"{float(value):.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql, folder) -> tuple[bool, str]:
    df = query(spark, folder)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(columns)}"
    want = rows_of(rel.fetchall(), columns)
    if got == want:
        return True, f"{len(got)} rows"
    a, b = set(map(repr, got)), set(map(repr, want))
    return False, f"{len(got)} rows against {len(want)}; only Spark {sorted(a - b)[:3]}, only SQL {sorted(b - a)[:3]}"


def main(folder: str, names: list[str]) -> None:
    import __spark_entry__ as e
    from skewline.session import build_session

    spark = build_session(master=f"local[{os.environ.get('BENCH_CPUS', 8)}]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connect(folder), e.queries(), e.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            ok, said = compare(spark, con, queries[name], sql[name], folder) if name in sql else (None, f"{queries[name](spark, folder).count()} rows, no SQL")
        except Exception as x:  # noqa: BLE001
            ok, said = False, f"{type(x).__name__}: {str(x)[:1500]}"
        print({True: "ok  ", False: "FAIL", None: "-   "}[ok], name, f"{time.time() - began:.1f}s", said, flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
