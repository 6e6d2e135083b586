"""Every core query with SQL gives what the SQL gives; the others are compared with Python."""

import pytest

from codexmill import registry
from tests.util import connect, same

SF = "/root/testdata/sf0.001"
Q, S = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(S))
def test_against_sql(spark, con, name):
    same(spark, con, Q[name](spark, SF), S[name])


def test_html_flatten(spark):
    from codexmill.sources.html import flatten

    rows = spark.read.parquet(f"{SF}/mobi_books.parquet").collect()
    assert {r.book_id: r.text for r in Q["html_flatten"](spark, SF).collect()} == {r.book_id: None if r.html is None else flatten(r.html) for r in rows}


def test_epub_round_trip(spark):
    n = {}
    for r in spark.read.parquet(f"{SF}/epub_sections.parquet").collect():
        n[r.book_id] = n.get(r.book_id, 0) + 1
    got = Q["epub_round_trip"](spark, SF).collect()
    assert {r.book_id: r.chapters for r in got} == n and all(r.title == f"book {r.book_id}" and r.chars > 0 for r in got)


def test_formatted_texts(spark):
    """Its properties are tested in test_text.py; here that every document has one row."""
    got = Q["formatted_texts"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_all_but_three_have_sql():
    assert set(Q) - set(S) == {"html_flatten", "epub_round_trip", "formatted_texts"}


def test_sql_has_queries():
    assert set(S) <= set(Q)
