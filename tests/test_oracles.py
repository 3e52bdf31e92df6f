"""Registered queries against DuckDB at the smallest scale.

MILLRACE_ALL_ORACLES=1 runs all of them; by default one or two per family. The command line tool
`oracle_compare.py` covers every query at any scale.
"""

import os

import pytest

import __spark_entry__ as entry
from millrace.plans import registry
from oracle_compare import compare, connect

SMALL = "/root/testdata/sf0.001"
DEFAULT = (
    "silver_parse", "silver_rejects", "ingest_counts", "index_table", "read_generations", "scalar_filter",
    "mode_routing", "bpm_context", "activity_interval_join", "report_rows", "bpm_impact_groups", "episodes",
    "anomaly_flag", "metrics_report", "paired_bootstrap", "agreement", "perturb_report", "refusal_matrix",
    "episode_boundaries", "window_fallback", "greedy_time_dedup", "rrf_fuse", "retrieve_filtered", "label_sample",
    "labelling_sheet", "labelling_subset", "claim_scores", "golden_evidence", "stream_silver", "pair_quota_select", "text_vectors", "assemble_prompts", "perturb_station", "golden_set",
)
SQL = {k: v for k, v in entry.oracle_sql().items() if k in registry.QUERIES}
NAMES = sorted(SQL) if os.environ.get("MILLRACE_ALL_ORACLES") else DEFAULT


def test_every_query_is_named_once():
    assert set(SQL) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.QUERIES) - set(SQL) == {"split_claims", "perturb_numbers", "perturb_variants", "ann_trained"}
    assert len(registry.QUERIES) == 123


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, name):
    ok, note, _ = compare(spark, connect(SMALL), name, entry.queries()[name], SQL[name], SMALL)
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 224 and "is_anomaly" in df.columns
