"""Run a query and its SQL counterpart on the same tables and report the first difference."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark_df, con, sql) -> str | None:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != sorted(spark_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} != {sorted(names)}"
    kind = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = {c: (t, types[c]) for c, t in spark_df.dtypes if kind.get(t, t) != types[c]}
    left = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    right = _rows(names, result.fetchall())
    if len(left) != len(right):
        return f"row counts differ: {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"rows differ ({sorted(names)}): {a} != {b}"
    wrong = {c: w for c, w in wrong.items() if {w[0], w[1]} != {"int", "BIGINT"} and {w[0], w[1]} != {"bigint", "INTEGER"}}
    return f"types differ: {wrong}" if wrong else None


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.conftest import local_session

    spark = local_session()
    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted and fn.__module__.rsplit(".", 1)[-1] not in wanted:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            problem = difference(df, con, sql[name]) if name in sql else (None if df.count() else "no rows")
        except Exception as exc:  # report and go on to the next query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        mark = "ok" if problem is None else "BAD"
        bad += problem is not None
        print(f"{mark:4}{name:28}{time.time() - start:7.2f}s {'' if name in sql else '(rows only) '}{problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
