"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

import check  # noqa: E402

from siftmill import catalog  # noqa: E402

catalog.load_all()


@pytest.fixture(scope="module")
def duck(small):
    return check.connect(small)


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query(spark, duck, small, key):
    said = check.compare(spark, duck, key, small)
    assert said.startswith(("ok", "rows-only")), said
    assert "TYPE" not in said, said


def test_entry_has_rows(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
