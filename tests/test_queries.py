"""The registered queries against their SQL on the smallest tables, where these are there."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FAST = (
    "p1_found", "search_text", "query_terms", "bm25_topk", "hybrid_search", "vector_topk", "range_join_counts", "asof_spans", "answer_history", "library_listing", "chunk_citations",
    "retrieval_metrics", "decline_agreement", "answer_citations", "cited_amounts", "sentence_chunks", "prompt_packing", "shared_nations", "point_in_interval", "order_intervals", "heading_chunks", "table_chunks", "chunk_parts", "canonical_answers",
    "fact_coverage", "place_metrics", "keyword_coverage", "stem_forms", "identifier_topk", "pause_chunks", "corrupted_numbers", "metric_changes",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables aren't there")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    found = entry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(plain(row[c]) for c in columns) for row in found.collect()), key=repr) == expected


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
