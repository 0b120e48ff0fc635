"""Every core query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from lettermill.plans import archive, problems

QUERIES = problems.QUERIES | archive.QUERIES
SQL = problems.SQL | archive.SQL


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, db, name):
    got = QUERIES[name](spark, small)
    columns = sorted(got.columns)
    result = db.execute(SQL[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    place = [theirs.index(c) for c in columns]
    mine = sorted(repr(tuple(r)) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    assert mine == sorted(repr(tuple(r[i] for i in place)) for r in result.fetchall())


def test_slugs_are_those_of_the_archives(spark, small):
    from lettermill.session import table

    slugs = QUERIES["archive_slug"](spark, small).join(table(spark, small, "pst_sources").withColumnRenamed("slug", "given"), "pst_id")
    assert slugs.where("slug <> given").count() == 0
