"""A cross-section of the registered queries against DuckDB on the smallest tables (``check.py`` runs them all)."""
import pytest

import check
from conftest import SF
from __spark_entry__ import entry, oracle_sql, queries

SAMPLE = ["history_clean", "phrase_parse", "phrase_majority", "vague_posterior", "two_request_evidence", "rule_match", "route_reasons",
          "accuracy_by_type", "team_precision_recall", "misroute_costs", "team_volumes", "linked_requests", "recent_context",
          "nearest_wording", "stream_corrections"]


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_answer(spark, duck, name):
    status, detail, _, _ = check.compare(spark, duck, name, SF)
    assert status == "same", detail


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
