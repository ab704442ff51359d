"""Compares a query's rows with those of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def same_rows(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    found = con.execute(sql)
    theirs = [c[0] for c in found.description]
    assert sorted(theirs) == names
    place = [theirs.index(c) for c in names]
    expected = sorted(tuple(shown(r[i]) for i in place) for r in found.fetchall())
    assert sorted(tuple(shown(v) for v in r) for r in df.select(*names).collect()) == expected
