"""Compares a query with its SQL in DuckDB: same columns, same rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(found):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v + 0.0, 9)
        return v

    return sorted((tuple(plain(v) for v in r) for r in found), key=repr)


def differences(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = rows(tuple(r[n] for n in names) for r in df.collect())
    cur = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})")
    theirs = rows(cur.fetchall())
    if mine == theirs:
        return None
    a, b = [x for x in mine if x not in theirs][:3], [x for x in theirs if x not in mine][:3]
    return f"{len(mine)} rows against {len(theirs)}; only here {a}; only there {b}"
