"""The queries that SQL can express, against it."""

from __future__ import annotations

import pytest
from turnloom.llm import queries

from ..oracle import compare, connect, sql_table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, small, name):
    compare(queries.QUERIES[name](spark, small).toArrow(), sql_table(connect(small), queries.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_rows(spark, small, name):
    assert queries.QUERIES[name](spark, small).toArrow().num_rows > 0  # all columns, as a count would leave them out
