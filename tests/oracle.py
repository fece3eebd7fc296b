"""Runs a query and its SQL and compares them by column name, values in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def compare(name, spark, sf_dir, query, sql):
    ours = query(spark, sf_dir)
    names = sorted(ours.columns)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    theirs = db.sql(sql)
    assert sorted(theirs.columns) == names, (name, theirs.columns, names)
    a = sorted((tuple(canonical(r[c]) for c in names) for r in ours.collect()), key=repr)
    cols = theirs.columns
    b = sorted((tuple(canonical(r[cols.index(c)]) for c in names) for r in theirs.fetchall()), key=repr)
    assert len(a) == len(b), (name, len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (name, len(bad), str(bad[0])[:1500])
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = {c: str(t) for c, t in zip(theirs.columns, theirs.types)}
    off = {c: (k, types[c]) for c, k in ours.dtypes if kinds.get(k, types[c]) != types[c]}
    assert not off, (name, off)
    return len(a)
