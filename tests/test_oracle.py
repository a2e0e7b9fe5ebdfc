"""Every core query with an SQL twin returns the twin's rows; the others return rows."""

import os

import pytest
from oracle import compare, connect

from tracewright.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, con, name):
    assert compare(spark, con, FOLDER, catalog.QUERIES[name], catalog.ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_some_rows(spark, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    assert df.columns and df.limit(1).count() == 1


def test_names_leave_room():
    import re

    assert not [n for n in catalog.QUERIES if re.match(r"p\d+_", n)]


def test_core_stands_alone():
    """Nothing outside the optional subpackage names it."""
    import pathlib
    import re

    import tracewright

    root = pathlib.Path(tracewright.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
