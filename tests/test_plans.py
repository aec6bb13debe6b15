"""Plan quality: what the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from conftest import SF_DIR

QUERIES = entry.queries()
BATCH = sorted(n for n in QUERIES if not re.match(r"i\d|s[2356]_", n))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def big_tables(spark):
    """Plan as if no table were small enough to broadcast."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield spark
    for key in keys:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", BATCH)
def test_no_pair_joins_and_no_python(big_tables, name):
    text = plan(QUERIES[name](big_tables, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert word not in text, word


@pytest.mark.parametrize("name", ["q14_databases", "q32_job_history", "d5_jobs"])
def test_rank_limit_runs_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    below = text[text.index("WindowGroupLimit"):]
    assert below.count("WindowGroupLimit") >= 2 and "Exchange hashpartitioning" in below


@pytest.mark.parametrize("name", ["f3_extract_errors", "f4_select_log_archives"])
def test_line_windows_are_sliced(spark, name):
    windows = re.findall(r"Window \[lag.*", plan(QUERIES[name](spark, SF_DIR)))
    assert any("_slice" in w.split("windowspecdefinition(")[1].split(" ASC")[0] for w in windows)


@pytest.mark.parametrize("name, column", [("r2_purge_error_log", "ts"), ("q36_run_log", "ts"), ("q32_job_history", "ts")])
def test_filters_reach_the_scan(spark, name, column):
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan(QUERIES[name](spark, SF_DIR)))
    assert any(f"({column}," in p for p in pushed), pushed


def test_forecast_reads_three_fact_columns_in_a_hash_aggregation(spark):
    text = plan(QUERIES["v2_volume_forecast"](spark, SF_DIR))
    assert "struct<l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in text
    assert "SortAggregate" not in text
