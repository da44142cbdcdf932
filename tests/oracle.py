"""Comparing a query's rows with those of its SQL."""

from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def available(sf: str = SF) -> bool:
    return Path(sf).is_dir()


def connection(sf: str = SF):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def rows(columns: list[str], values) -> list[tuple]:
    return sorted(values, key=lambda r: [(v is None, str(v)) for v in r])


def compare(spark, query, sql: str, con, sf: str = SF) -> None:
    df = query(spark, sf)
    columns = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    expected = rows(columns, found.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert rows(columns, [tuple(r[c] for c in columns) for r in df.collect()]) == expected
