"""Every query against DuckDB over the smallest tables."""

from __future__ import annotations

import pathlib

import pytest

from tablerelay.queries import all_queries, all_sql
from tests.parity import compare, connect

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_every_query_is_checked():
    assert set(all_sql()) == set(all_queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, database, name):
    assert compare(all_queries()[name](spark, FOLDER), database, all_sql()[name]) == []
