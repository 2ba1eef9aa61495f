"""The registered queries on the smallest tables: SQL twins, columns and held-out accuracy."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from check import TABLES, rows_of
from trailspan.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op2_html_extract": ["page_id", "url", "text", "n_chars"],
    "op3_warc_salvage": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], "op4_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op6_quality": ["doc_id", "held_out", "score", "predicted"], "op7_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op9_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op12_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    cur = duck.execute(ORACLE[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert rows_of(df.columns, df.collect()) == want and want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_whole_table(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    assert df.columns[:len(COLUMNS.get(name, []))] == COLUMNS.get(name, [])
    rows = df.collect()
    if name != "op10_decontaminate":
        table, key = ("pages", "page_id") if name in ("op2_html_extract", "op3_warc_salvage") else ("documents", "doc_id")
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in duck.execute(f"SELECT {key} FROM {table}").fetchall())


def test_held_out_accuracy(spark, duck):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    found = [r for r in queries()["op7_langid"](spark, FOLDER).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in found) >= 0.95 * len(found)
