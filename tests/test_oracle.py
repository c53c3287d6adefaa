"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
from check import connect, differences

from leafscan.plans import registry

SF_DIR = os.environ.get("LEAFSCAN_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


# Iterative or free-text rules that SQL cannot say; their operators have tests of their own in test_jobs and test_text.
ROWS_ONLY = set(
    "b4_html_text c3_split_legal c5_split_corpus c8_subsplit c9_inner_split d7_entities f15_expand_pointers f16_hint_search f23_local_subsearch "
    "f24_inner_focus f25_focus f26_evidence_notes f29_reference_followup f38_initial_round f39_followup_round f40_repair_round g3_chat_route "
    "g7_doc_hints g8_reroute k5_task_cases".split()
)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF_DIR).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert name in ROWS_ONLY, "a new query needs SQL"
        assert len(got) > 0
        return
    assert differences(got, duck.sql(sql).df()) == []


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "domain", "doc_id", "page_id", "score", "rank", "heading_path", "quote"]
