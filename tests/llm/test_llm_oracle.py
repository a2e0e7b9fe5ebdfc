"""The training-data queries against their SQL twins."""

import os

import pytest
from oracle import compare, connect

from tracewright.llm import oracle, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_same_rows(spark, shared, name):
    assert compare(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], oracle.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE)))
def test_some_rows(spark, shared, name):
    assert queries.QUERIES[name](spark, FOLDER).limit(1).count() == 1
