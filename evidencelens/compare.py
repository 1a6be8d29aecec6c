"""Order-insensitive comparison of a Spark result with the same query in DuckDB."""

from __future__ import annotations

import math

# The tables of the test data.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for row in rows:
        cells = []
        for i in order:
            v = row[i]
            if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
                cells.append((type(v).__name__, v))
            elif isinstance(v, float):
                cells.append(("float", "nan" if math.isnan(v) else v))
            else:
                cells.append((type(v).__name__, str(v)))
        out.append(tuple(cells))
    return sorted(out, key=repr)


def compare_query(spark, con, fn, sql, folder) -> str:
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"ok rows-only {len(rows)}" if rows else "EMPTY"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} sql={sorted(names)}"
    a, b = canonical(rows, df.columns), canonical(expected, names)
    if len(a) != len(b):
        return f"ROWS spark={len(a)} sql={len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"VALUES {len(bad)}/{len(a)} differ {sorted(names)}; first spark={[c[1] for c in bad[0][0]]} sql={[c[1] for c in bad[0][1]]} types={[c[0] for c in bad[0][0]]}/{[c[0] for c in bad[0][1]]}"
    return f"ok {len(a)}" if a else "EMPTY"
