"""Every registered engine query against its SQL on the smallest tables."""

import os

import duckdb
import pytest
from inkwell import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q in queries.ORACLE])
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda row: tuple(str(v) for v in row)
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want.select(*[f'"{c}"' for c in columns]).fetchall()))


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in queries.ORACLE])
def test_rows_only(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_a_changed_construct_changes_the_answer(spark, monkeypatch):
    """The truth comes from parsing: without blanks after the marks there are no headings."""
    plain = queries.nation_documents

    def broken(spark, sf_dir):
        return plain(spark, sf_dir).selectExpr("doc_id", "replace(source, '## ', '##') as source")

    monkeypatch.setattr(queries, "nation_documents", broken)
    assert {r.level for r in queries.heading_levels(spark, SF).collect()} == {1}
