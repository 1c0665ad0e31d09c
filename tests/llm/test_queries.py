"""Every query with a SQL twin against it; the others against brute force in their own files."""

import pytest
from compare import compare, connect

from skytrace.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, SQL[name]) == []


def test_all_operators():
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 14))
