"""Plans are what they should be: filters and columns reach the scan, one shuffle serves a group, no Python where none is needed."""

import io
import os
import re
from contextlib import redirect_stdout

import pytest

from tracewright.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

#: Queries whose rule no built-in expression has.
PYTHON = re.compile(r"^(f10|f19_number|f20|e06|e07|e08|e09|e10|e12|e30|w02|gae|w07|discounted|balance|b0[1-8]|pack_|c01|r0|x0|s0?1$)")


def plan(spark, name):
    out = io.StringIO()
    with redirect_stdout(out):
        catalog.QUERIES[name](spark, FOLDER).explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "sel_p04_key_range")
    assert "GreaterThanOrEqual(event_id,100)" in p and "LessThan(event_id,300)" in p
    assert re.search(r"ReadSchema: struct<event_id:bigint,event_type:string>", p)


def test_one_shuffle_serves_mean_deviation_and_count(spark):
    p = plan(spark, "group_norm_advantage")
    assert "partial_count" in p and "Window" not in p and len(re.findall(r"^\(\d+\) HashAggregate", p, re.M)) == 2
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in p


def test_top_k_is_pruned_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "histogram_topk") and "WindowGroupLimit" in plan(spark, "first_n_per_class")


def test_aggregates_combine_before_the_shuffle(spark):
    p = plan(spark, "a04_success_counters")
    assert "partial_count" in p and len(re.findall(r"^\(\d+\) Exchange", p, re.M)) == 1


#: A grid or a comparison with every fact by definition, or a join with one row.
PRODUCTS = {"j08_best_of_cross", "j17_dense_grid", "masked_whiten", "w07_gae_whitened"}


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if not n.startswith(("s", "r", "x", "keyed"))))
def test_no_python_and_no_product_in_the_plan(spark, name):
    p = plan(spark, name)
    if not PYTHON.match(name):
        assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas|MapInArrow|PythonUDF", p)
    if name not in PRODUCTS:
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", p)
