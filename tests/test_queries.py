"""Registered queries against their SQL on the smallest tables."""

import os
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest

from marginalia.catalog import all_oracles, all_queries

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
SF = "/root/testdata/sf0.001"
SAMPLE = (
    "row_contract", "norm_date", "enum_match_join", "len_stats_linear", "chat_row_contract", "join_user_text",
    "split_stratified", "pointer_leaves", "validate_closed", "row_verdict", "leaf_f1_counts", "leaf_recall_counts",
    "path_accuracy_total", "priority_diffs", "ingest_errors", "wide_projection",
)


def test_every_query_with_sql_is_registered():
    assert set(all_oracles()) <= set(all_queries()) and len(all_queries()) > 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    from check_queries import check, connect

    same, message, mine, theirs = check(spark, connect(SF), SF, name, all_queries()[name], all_oracles()[name])
    assert same, message


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_all_other_queries_equal_their_sql(spark):
    """Three at a time: most of the time of a small query is planning."""
    from check_queries import check, connect

    queries, oracles, con = all_queries(), all_oracles(), connect(SF)

    def one(name):
        return name, check(spark, con.cursor(), SF, name, queries[name], oracles[name])[:2]

    with ThreadPoolExecutor(3) as pool:
        found = list(pool.map(one, [name for name in oracles if name not in SAMPLE]))
    assert [(name, message) for name, (same, message) in found if not same] == []
