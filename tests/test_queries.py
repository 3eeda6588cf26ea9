"""Each query against its SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def canonical(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(canonical(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = rows_of(names, found.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).columns


def test_same_site_gaps(spark, sf, tmp_path):
    """Pairs reach over gaps in the ids."""
    import duckdb

    spark.read.parquet(f"{sf}/pages.parquet").where("page_id % 5 <> 2").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = entry.queries()["same_site_pairs"](spark, str(tmp_path))
    found = c.execute(entry.oracle_sql()["same_site_pairs"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in found.description], found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
