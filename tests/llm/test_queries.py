"""The registered queries: their contracts' columns, and DuckDB's rows where there is SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF, assert_same
from motionspark.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op2": [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")],
    "op3": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op5": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")],
    "op6": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op7": [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")],
    "op10": [
        ("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"),
        ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"),
    ],
    "op11": [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")],
    "op12": [
        ("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint"),
    ],
    "op13": [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")],
}


def test_one_query_each():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(entry.queries()) >= {*QUERIES, "pipeline"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_covers_the_table(spark, name):
    out = entry.queries()[name](spark, SF)
    want = COLUMNS.get(name.split("_")[0])
    if want:
        assert out.dtypes[: len(want)] == want
    if not name.startswith("op9"):
        assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    out = entry.queries()[name](spark, SF)
    want = COLUMNS.get(name.split("_")[0])
    if want:
        assert out.dtypes[: len(want)] == want
    assert_same(out, ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_on_messy_texts(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)
