"""Compare a Spark result with its SQL in DuckDB, order left aside."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf: str):
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        db.execute(f"create view {name} as select * from '{path}'")
    return db


def plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float) and value != value:
        return (2, "nan")
    if isinstance(value, (int, float)):
        return (2, f"{float(value):.9g}")
    return (3, str(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, db, sql: str) -> str | None:
    """None if both agree, else what differs first."""
    got = df.collect()
    return difference_of_rows(df, got, db, sql)


def difference_of_rows(df, got, db, sql: str) -> str | None:
    found = db.execute(sql)
    sql_names, sql_types = [d[0] for d in found.description], [str(d[1]) for d in found.description]
    expected = found.fetchall()
    if sorted(df.columns) != sorted(sql_names):
        return f"columns {sorted(df.columns)} / {sorted(sql_names)}"
    if len(got) != len(expected):
        return f"rows {len(got)} / {len(expected)}"
    a, b = rows_of(df.columns, got), rows_of(sql_names, expected)
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(df.columns)}\n  spark {x}\n  sql   {y}"
    kinds = dict(zip(sql_names, sql_types))
    pairs = {c: (t, kinds[c]) for c, t in df.dtypes if kind(t) != kind(kinds[c].lower())}
    return f"types {pairs}" if pairs else None


def kind(name: str) -> str:
    name = name.lower()
    for group, members in {
            "int": ("int", "bigint", "integer", "hugeint", "smallint", "number", "long"),
            "double": ("double", "float", "decimal"), "text": ("string", "varchar", "str"),
            "bool": ("boolean", "bool"), "time": ("timestamp", "datetime")}.items():
        if any(name.startswith(m) for m in members):
            return group
    return name
