"""Runs queries on Spark and their SQL twins on DuckDB and compares all values."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if hasattr(v, "as_tuple"):
        return round(float(v), 9)
    if isinstance(v, int):
        return float(v)
    return str(v) if v is not None else None


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql) -> str | None:
    df = query(spark, sf_dir)
    left_cols, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if left else "no rows"
    result = con.execute(sql)
    right_cols, right = rows_of([d[0] for d in result.description], result.fetchall())
    if left_cols != right_cols:
        return f"columns {sorted(set(left_cols) ^ set(right_cols))}"
    if left != right:
        only_l, only_r = left - right, right - left
        key = lambda t: tuple(str(x) for x in t)
        return (
            f"{sum(left.values())} vs {sum(right.values())} rows, {sum(only_l.values())} differ: "
            f"{left_cols} {sorted(only_l, key=key)[:2]} | {sorted(only_r, key=key)[:2]}"
        )
    return None if left else "no rows on either side"


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tidemark.session import build_session

    sf = argv[0] if argv else "sf0.01"
    wanted = argv[1].split(",") if len(argv) > 1 else None
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{sf}"
    con, sqls, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(name == w or name.startswith(w + "_") for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, query, sqls.get(name))
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s "
              f"{'' if name in sqls else '(rows only) '}{problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
