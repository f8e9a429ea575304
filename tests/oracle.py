"""Holds a registered query against its SQL on DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def same(spark, sf_dir, fn, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.execute(sql)
    names = [c[0] for c in want.description]
    got = fn(spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    key = lambda rows: sorted(repr([value(x) for x in r]) for r in rows)
    assert key(tuple(r) for r in got.select(*[f"`{n}`" for n in names]).collect()) == key(want.fetchall())
