"""Runs registered queries beside their SQL in DuckDB: python -m tests.compare [--sf DIR] [NAME or prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"create view {path.stem} as select * from '{source}'")
    return con


def plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows(columns: list[str], data: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    got = rows(df.columns, df.collect())
    if got != want:
        return f"{sum(got.values())} rows and {sum(want.values())}; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return ""


def main(args: list[str]) -> int:
    import __spark_entry__ as entry
    from scenarium.session import build_session

    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = views(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if args and not any(name == a or name.startswith(a) for a in args):
            continue
        began = time.time()
        try:
            df = query(spark, folder)
            said = differences(df, con, sql[name]) if name in sql else f"no SQL, {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
