"""Every query that SQL can state, against that SQL on the smallest data."""

import pytest
from oracle import DATA, spark_rows, sql_rows

from loomtree.plans import annotation_queries, dealt, state_queries

MODULES = (dealt, annotation_queries, state_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = spark_rows(QUERIES[name](spark, f"{DATA}/{SF}"))
    assert got == sql_rows(ORACLES[name], SF)


def test_queries_without_sql_are_tested_elsewhere():
    """test_align.py and test_nested.py hold them against the matcher, the tokenizer, their rules and a round trip."""
    assert set(QUERIES) - set(ORACLES) == {"aln_5_unequal_texts", "seg_7_bpe_tokens", "api_3_4_5_submit", "api_6_commit", "p4_levels"}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
