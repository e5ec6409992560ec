"""Compare registered queries with their SQL on DuckDB (value by value, any row order).

    python tests/compare.py [--sf 0.01] [names ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if hasattr(v, "isoformat"):
        return (2, v.isoformat().replace("T00:00:00", ""))
    if isinstance(v, (int, float)):
        return (3, repr(round(float(v), 9) + 0.0))
    if isinstance(v, (list, tuple)):
        return (4, str([cell(x) for x in v]))
    return (5, str(v))


def compare(df, con, sql) -> str:
    """Empty when equal, otherwise what differs."""
    cols = sorted(df.columns)
    mine = sorted(tuple(cell(v) for v in row) for row in df.select(*cols).collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} != {sorted(rel.columns)}"
    want = sorted(
        tuple(cell(v) for v in row)
        for row in rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()
    )
    if len(mine) != len(want):
        return f"rows {len(mine)} != {len(want)}; mine {mine[:2]} want {want[:2]}"
    bad = [(a, b) for a, b in zip(mine, want) if a != b]
    types = dict(zip(rel.columns, map(str, rel.types)))
    note = ""
    if bad:
        a, b = bad[0]
        diff = [(c, x[1], y[1]) for c, x, y in zip(cols, a, b) if x != y]
        note = f"{len(bad)}/{len(mine)} rows differ; first {diff} in {a}"
    kinds = {"HUGEINT", "DECIMAL"}
    odd = [c for c, t in types.items() if t.split("(")[0] in kinds]
    pair = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    off = [(c, t, types[c]) for c, t in df.dtypes if pair.get(t, t) != types[c]]
    if odd or off:
        note += f" TYPES {odd} {off}"
    return note


def main() -> int:
    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    folder = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry
    from crossrank.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                note = compare(df, duck(folder), sql[name])
            else:
                note = "" if df.count() >= 0 else "?"
        except Exception as error:  # noqa: BLE001
            note = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(note)
        took = time.time() - start
        print(f"{'FAIL' if note else 'ok  '} {name:38} {took:6.2f}s {'' if name in sql else '(rows only)'} {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
