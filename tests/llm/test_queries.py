from __future__ import annotations

import re

import pytest

from posespark.llm import queries as q

ORACLES = q.oracle_sql()


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(name, same_rows):
    same_rows(q.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", [n for n in q.queries() if n not in ORACLES])
def test_query_without_sql_runs(name, spark, sf_dir):
    df = q.queries()[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_every_operator():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in q.queries()] == list(range(1, 14))
