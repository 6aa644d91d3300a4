"""Runs a query beside its SQL in DuckDB and compares the rows, in any order."""

from pathlib import Path

import duckdb

DATA = "/root/testdata"


def duck(sf: str):
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(map(repr, pdf[cols].astype(object).where(pdf[cols].notna(), None).itertuples(index=False, name=None)))


def same(spark, query, sql: str, sf: str) -> int:
    df = query(spark, sf)
    got, want = df.toPandas(), duck(sf).execute(sql).df()
    for c in [c for c, kind in df.dtypes if kind in ("int", "bigint")]:  # pandas shows integers beside nulls as floats
        for pdf in (got, want):
            pdf[c] = [None if x is None or x != x else int(x) for x in pdf[c].astype(object)]
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b), (len(a), len(b))
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    assert not diff, diff[:3]
    return len(a)
