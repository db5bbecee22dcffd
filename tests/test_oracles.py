"""A sample of registered queries against their SQL; ``tests/compare.py`` runs all of them."""

import pytest
from compare import database, mismatch

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "queue_topk", "why_above_next", "signal_features", "secret_redact_scan", "task_span_extract", "content_dedup", "id_components",
    "source_chunk_join", "approval_compaction", "case_grade", "latency_percentiles", "rate_limit_windows", "tfidf_topk", "question_plan",
    "state_contradictions", "packet_graph", "passage_grounding_check",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    assert mismatch(entry.queries()[name](spark, FOLDER), database(FOLDER), entry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
