"""Registered queries against their SQL in DuckDB, on the smallest tables where they are at hand."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")

# A cross-section; all queries are compared in the same way before each release.
NAMES = (
    "chunk_documents", "stable_document_id", "normalize_urls", "dedup_pages", "scan_injection", "redact_text", "infer_csv_types", "robots_filter", "bm25_score", "knn_exact", "sentence_windows", "fuse_weighted_rrf", "hybrid_search",
    "match_rules", "route_with_margin", "group_by_aggregate", "tenant_filter", "canonicalize_entities", "retrieve_graph", "pack_batches", "validate_citations", "score_cases", "verify_audit_chain", "apply_retention", "rate_limit_windows",
    "check_lifecycle", "reconcile_stores", "stream_counts", "governed_view", "stream_ingest", "embed_incremental", "read_csv_strict", "csv_contract_check", "file_inventory_gate", "answer_batch", "latency_cost_summary", "crawl_pages",
    "purge_retention", "label_observations", "edge_citations", "compare_reranking", "benchmark_violations", "stream_rate_windows", "deployment_gates", "reports", "graph_snapshot",
)


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return None if math.isnan(value) else round(float(value), 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, tables, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    found = tables.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
