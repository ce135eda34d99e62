"""Side-by-side comparison of a Spark result with its SQL, as tests use it."""

from __future__ import annotations

import math


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if hasattr(v, "tolist"):
        return normal(v.tolist())
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    return v


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, connection, sql: str, most: int = 3) -> list:
    """First rows that only one side has; an empty list if both agree in names and rows."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return [("columns", sorted(spark_df.columns), sorted(names))]
    if ours == theirs:
        return []
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return [("rows", len(ours), len(theirs)), *[("spark", x[:300]) for x in sorted(a - b)[:most]], *[("sql", x[:300]) for x in sorted(b - a)[:most]]]
