"""Runs a query and its SQL side by side."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(value):
    if value is None:
        return ("0",)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("f", "nan" if value != value else repr(round(value, 6) + 0.0))
    if isinstance(value, (list, tuple)):
        return ("l", tuple(canon(v) for v in value))
    if isinstance(value, dict):
        return ("d", tuple(sorted((k, canon(v)) for k, v in value.items())))
    return (type(value).__name__, str(value))


def duck(sf_dir, sql, views=None):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return names, cursor.fetchall()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(canon(r[i]) for i in order) for r in data)


def compare(df, sf_dir, sql):
    ours = rows(df.columns, [tuple(r.asDict(recursive=True)[c] for c in df.columns) for r in df.collect()])
    theirs = rows(*duck(sf_dir, sql))
    assert ours[0] == theirs[0], (ours[0], theirs[0])
    odd = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b][:3]
    assert len(ours[1]) == len(theirs[1]), (len(ours[1]), len(theirs[1]), odd)
    assert not odd, odd
    return len(ours[1])
