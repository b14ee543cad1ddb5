"""Queries against their SQL in DuckDB on the smallest driver tables."""

import math
import os

import pytest

from ctxloom.plans import ledger_queries, registry, session_queries, surface_queries, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = ["orders", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "part", "nation", "region"]
SOME = ["fingerprint_documents", "near_duplicates_line_jaccard", "extract_symbols", "exact_facts_per_document", "calibrated_tokens", "greeting_flags", "pair_units", "recent_floor", "protection_lanes", "tier_hysteresis", "segments", "calibrated_range", "history_ring", "continuation_runs", "ledger_entries", "citations", "memory_search", "group_atomicity", "id_minting", "route_validation", "memory_class", "prune_drops", "planned_units", "planner", "apply_ops", "matched_entries", "render_context", "provenance_resolution", "provenance_repair", "region_facts", "compaction_outcomes", "request_guard", "calibrated_loop", "prune_stats", "integrity_issues", "coverage_check", "exact_duplicates", "model_capabilities", "overflow_messages", "continuation_steps", "nested_texts", "priced_sessions", "landed_surface", "landed_events", "router_pages", "tiers_in_force", "history_points", "executed_by_kind", "route_settings", "reduced_results"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    made = pytest.importorskip("duckdb").connect()
    for name in TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return made


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(registry.SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(names) == columns and got == want
