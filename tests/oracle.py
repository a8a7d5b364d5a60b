"""Compare a registered query with its SQL twin in DuckDB (used by the tests)."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(sf_dir) / name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NULL"
        return f"{round(value, 6) + 0.0:.6f}"
    return "NULL" if value is None else str(value)


def _rows(table, names):
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(_cell(v) for v in row) for row in zip(*columns)) if columns else []


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and the SQL result; empty when they agree."""
    ours, theirs = df.toArrow(), con.execute(sql).to_arrow_table()
    names = sorted(ours.column_names)
    if names != sorted(theirs.column_names):
        return [f"columns {names} vs {sorted(theirs.column_names)}"]
    problems = []
    for n in names:
        a, b = str(ours.schema.field(n).type), str(theirs.schema.field(n).type)
        if a.replace("large_", "") != b.replace("large_", ""):
            problems.append(f"type of {n}: {a} vs {b}")
    left, right = _rows(ours, names), _rows(theirs, names)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    if left != right:
        only_left, only_right = sorted(set(left) - set(right))[:2], sorted(set(right) - set(left))[:2]
        problems.append(f"values {names}: only here {only_left}, only there {only_right}")
    elif not left:
        problems.append("no rows")
    return problems
