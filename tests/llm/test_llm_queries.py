import pytest
from oracle import DATA, spark_rows, sql_rows

from loomtree.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = spark_rows(QUERIES[name](spark, f"{DATA}/sf0.001"))
    if name in ORACLES:
        assert got == sql_rows(ORACLES[name], "sf0.001")
    else:
        assert sum(got[1].values()) > 0
