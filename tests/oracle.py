"""Compares queries with their SQL in DuckDB, as bags of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return int(v) if isinstance(v, (int, bool)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in data)


def differences(spark, sf_dir: str, query, sql: str) -> str | None:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    if want[0] != got[0]:
        return f"columns {got[0]} instead of {want[0]}"
    if want[1] != got[1]:
        more, less = got[1] - want[1], want[1] - got[1]
        return f"{more.total()} rows more, such as {list(more)[:2]}; {less.total()} missing, such as {list(less)[:2]}"
    return None
