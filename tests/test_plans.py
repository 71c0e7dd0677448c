"""Physical plans of the main jobs."""

import re

import pytest

import __spark_entry__ as registry
from heatsheet.functions import NAME_COLLATION
from heatsheet.plans import listings, results, search
from heatsheet.sources import star

SF_DIR = "/root/testdata/sf0.001"
STAGES = registry.STAGES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark):
    return star.tables(spark, SF_DIR)


@pytest.fixture
def static(conf):
    """The plan as first chosen for tables too large to broadcast."""
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_stage_bests_shuffle_once_after_partial_aggregation(tables, static):
    plan = _plan(results.stage_bests(tables["run"], STAGES))
    assert plan.count("Exchange") == 1
    assert "partial_min" in plan and "Window" not in plan


def test_run_totals_need_no_second_shuffle(tables, static):
    assert _plan(results.run_totals(tables["run"])).count("Aggregate") <= _plan(tables["run"]).count("Aggregate")


def test_no_job_runs_while_a_plan_is_made(spark):
    context = spark.sparkContext
    context.setJobGroup("planning", "plans only")
    try:
        for name in ("run_details", "runs_by_course", "runs_by_driver", "driver_search", "edit_receipts"):
            registry.core_queries()[name](spark, SF_DIR)
        assert not context.statusTracker().getJobIdsForGroup("planning")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_leaders_are_taken_without_a_sort_and_share_the_aggregation(tables, static):
    plan = _plan(
        results.overall_results(tables["driver"], tables["car"], tables["run"], tables["course"], STAGES)
    )
    assert "TakeOrderedAndProject(limit=5" in plan
    assert plan.count("ReusedExchange") >= 1


def test_top_n(tables, static):
    plan = _plan(
        results.top_n(
            results.stage_results(tables["driver"], tables["car"], tables["run"], tables["course"], STAGES)
        )
    )
    assert "TakeOrderedAndProject(limit=5" in plan and "rangepartitioning" not in plan


def test_search_filters_below_the_aggregation(tables, static):
    plan = _plan(
        search.driver_search(
            tables["driver"], tables["car"], tables["run"], tables["course"], STAGES, registry.TERM
        )
    )
    lines = plan.splitlines()
    aggregate = next(i for i, line in enumerate(lines) if "partial_min" in line)
    assert any("LeftSemi" in line for line in lines[aggregate:])


def test_one_driver_is_pushed_to_every_scan(tables, static):
    plan = _plan(
        listings.run_details(
            tables["driver"], tables["run"], tables["course"], tables["car"], 7
        )
    )
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(c_custkey,7\)", plan)
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(o_custkey,7\)", plan)


def test_scans_read_only_needed_columns(tables):
    plan = _plan(results.stage_bests(tables["run"], STAGES))
    columns = set(re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1).split(","))
    assert {c.split(":")[0] for c in columns} == {
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
    }
    header = _plan(listings.run_header(tables["driver"], tables["run"], tables["car"], 7))
    assert "o_totalprice" not in header


def test_collated_listing_keeps_pruning_and_range_partitions(spark, static):
    drivers, cars = star.accented(spark, SF_DIR), star.car(spark, SF_DIR)
    plan = _plan(listings.list_drivers(drivers, cars, NAME_COLLATION))
    assert "rangepartitioning" in plan and "SinglePartition" not in plan
    assert "o_orderkey" not in plan and "n_regionkey" in plan
    found = _plan(drivers.filter(search.name_matches("jose", NAME_COLLATION)).filter("driver_id < 50"))
    assert "LessThan(c_custkey,50)" in found and "Python" not in found


def test_map_of_courses_needs_no_more_shuffles_than_named_stages(tables, static):
    args = (tables["driver"], tables["car"], tables["run"], tables["course"])
    wide = _plan(results.stage_results(*args, STAGES))
    assert _plan(results.stage_results(*args)).count("Exchange") <= wide.count("Exchange")
