"""Order-free comparison of a Spark result and a DuckDB result."""

import decimal


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    return list(map(cell, v)) if isinstance(v, list | tuple) else v



def same(df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    left = sorted(repr([cell(r[c]) for c in order]) for r in (x.asDict() for x in df.collect()))
    at = [names.index(c) for c in order]
    right = sorted(repr([cell(r[i]) for i in at]) for r in found.fetchall())
    assert left == right, (list(set(left) - set(right))[:3], list(set(right) - set(left))[:3])
    return len(left)
