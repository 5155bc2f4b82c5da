"""Compares a registered query with its SQL in DuckDB: same columns, same rows in any order."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if hasattr(v, "quantize"):
        return round(float(v), 6)
    return v


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same."""
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in res.fetchall())
    kinds = {d[0]: str(d[1]) for d in res.description}
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    for c, k in df.dtypes:
        d = kinds[c]
        if (k in ("bigint", "int", "double")) and {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}[k] != d:
            return f"type of {c}: {k} and {d}"
    if got == want:
        return "" if got else "no rows"
    return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:2]}; only SQL {list((want - got).items())[:2]}"
