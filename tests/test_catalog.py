"""A sample of registered queries against their SQL at the smallest scale."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
SAMPLE = ["r2_bm25_search", "v1_recall_and_mrr", "t7_candidate_lines", "g3_guard_verdicts", "l3_deck_summary",
          "k3_note_chunks", "x1_page_neighbours", "m5_answer_warnings", "s2_log_scan", "st3_session_state"]


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__
    return __spark_entry__


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, entry, name):
    from check_oracle import compare, duck
    status, n, note = compare(spark, duck(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", note


def test_every_oracle_has_a_query(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_stream_equals_batch(spark, entry):
    rows = lambda name: sorted(tuple(r) for r in entry.queries()[name](spark, SF).collect())
    assert rows("st5_drill_stream") == sorted((r[0], r[1], r[2], r[3], r[4]) for r in rows("p7_drill"))
