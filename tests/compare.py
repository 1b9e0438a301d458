"""Rows of a query and of its SQL, in a form that can be compared."""

from datetime import datetime


def value(x):
    if isinstance(x, float):
        return "null" if x != x else f"{x:.6g}"
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    return "null" if x is None else str(x)


def same(df, con, sql: str) -> None:
    found = con.execute(sql)
    columns = sorted(df.columns)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(value(r[names.index(c)]) for c in columns) for r in found.fetchall())
    ours = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    assert ours == theirs
