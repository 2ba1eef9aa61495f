"""Each query on the smallest tables against its SQL twin."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of
from trailspan.catalog import QUERIES
from trailspan.oracle import statements

FOLDER = "/root/testdata/sf0.001"
# The full set runs with check.py; these touch every module and every plan shape.
SAMPLE = [
    "track_segments", "resample_track", "track_chunks", "categorize", "corridor_join", "poi_dedup", "distance_sweep", "gpx_ingest", "page_preview",
    "availability_flags", "cache_upsert", "cache_split", "enrichment_worklist", "url_normalize", "snippet_topk", "price_level", "hours_table",
    "mappage_extract", "hours_block", "jsonld_extract", "llm_output_gate", "deterministic_enrich", "job_stats", "geojson_export", "engine_health", "ttl_misses",
    "geojson_enriched", "gpx_plain", "gpx_export", "source_region", "distance_counts", "poi_sort_name", "mappage_hours", "osm_dedup", "snippet_dedup", "snippet_union",
    "structured_content", "job_latest", "cache_lookup", "rating_extract", "divergences", "corridor_runs", "track_length", "elevation_stats",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    cur = duck.execute(oracle_sql()[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert rows_of(df.columns, df.collect()) == want and want[1]


def test_works_without_the_subpackage(tmp_path):
    """A copy without ``llm`` and its tests, with or without the pipeline, still registers the library's queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", "*.md"))
    script = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'corridor_pois' in q and 'pipeline' not in q and set(o) <= set(q), sorted(q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", script], cwd=copy, check=True, timeout=100)
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(statements()) <= {"kml_export"}
    assert set(QUERIES) <= set(queries()) and set(statements()) <= set(oracle_sql())
    assert entry(spark).count() > 0


def test_cache_upsert_of_many_customers(spark, tmp_path):
    """Keys of customers far beyond the small tables, and negative order keys."""
    folder, con = str(tmp_path), duckdb.connect()
    con.execute(f"""COPY (SELECT CASE WHEN k % 5 = 0 THEN -k ELSE k END AS o_orderkey, 1 + k * 450 AS o_custkey, 'O' AS o_orderstatus, 1e0 AS o_totalprice,
      TIMESTAMP '2001-01-01' + INTERVAL 1 DAY * (k % 90) AS o_orderdate, 'x' AS o_orderpriority FROM range(400) t(k)) TO '{folder}/orders.parquet'""")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    for t in set(TABLES) - {"orders"}:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries()["cache_upsert"](spark, folder)
    cur = con.execute(oracle_sql()["cache_upsert"])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert rows_of(df.columns, df.collect()) == want and want[1]
