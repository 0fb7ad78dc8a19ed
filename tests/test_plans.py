"""Plans of substring, prefix and rule queries stay free of nested-loop joins and row-wise Python."""

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["host_sdk_attribution", "caller_sdk_longest_prefix", "leak_value_detect", "undeclared_items", "vague_terms", "undisclosed_sdk", "api_traffic_correlation", "item_classify"])
def test_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("NestedLoop", "Cartesian", "BatchEvalPython"))


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["api_traffic_correlation"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "props" not in plan
