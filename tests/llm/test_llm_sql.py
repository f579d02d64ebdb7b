"""Queries with SQL: Spark equals DuckDB on the smallest tables."""
import os
import sys

import duckdb
import pytest

from cohortab.llm import queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    from check_oracle import TABLES, digest, type_diff

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    sql = queries.oracle_sql()[name]
    assert type_diff(df, con.sql(sql)) == {}
    res = con.execute(sql)
    names, rows = [d[0] for d in res.description], res.fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(names) == sorted(df.columns) and len(got) == len(rows)
    assert digest(df.columns, got)[0] == digest(names, rows)[0]


def test_contract_columns(spark):
    want = {"op3_rendezvous_sharding": "doc_id size text_crc32 law shard slot grown_shard",
            "op5_embedding_dedup": "vec_id n_links component_id kept",
            "op6_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
            "op7_quality_classifier": "doc_id held_out score predicted",
            "op8_simhash": "doc_id fingerprint component_id",
            "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed words_left kept",
            "op10_url_filter": "page_id host path rule verdict"}
    assert set(want) <= set(queries.queries())
    for name in ("op9_quality_rules", "op10_url_filter", "op3_rendezvous_sharding"):
        assert queries.queries()[name](spark, SF).columns == want[name].split()
