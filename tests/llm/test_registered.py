"""The registered queries: one per operator, and those with SQL against DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

import check  # noqa: E402

from siftmill.llm import queries  # noqa: E402


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_sql(spark, medium, key):
    got = queries.QUERIES[key](spark, medium)
    answer = check.connect(medium).execute(queries.ORACLES[key])
    names = [c[0] for c in answer.description]
    want = check.rows_of(names, answer.fetchall())
    assert check.rows_of(got.columns, [tuple(r) for r in got.collect()]) == want
    assert want[1]


def test_all_are_registered():
    import __spark_entry__ as contract

    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op"))
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) <= set(contract.queries())
    assert set(queries.ORACLES) <= set(contract.oracle_sql())
