"""Physical plans: what may and may not occur, also when nothing fits a broadcast."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from barrelbook import operators as ops
from workload.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
STREAMS = {name for name in queries() if name.startswith("stream_")}
PYTHON = {"html_cards", "page_summaries", "html_menu_items", "catalogue_enrichment", "catalogue_summary"}
WRITERS = {"daily_refresh", "csv_after_preamble", "table_export", "created_table_latest"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark):
    """As if every table were too large to broadcast by size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - STREAMS - WRITERS))
def test_no_cross_joins_and_no_python(large, name):
    shown = plan(queries()[name](large, FOLDER))
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown
    if name not in PYTHON:
        assert "MapInPandas" not in shown and "PythonUDF" not in shown and "BatchEvalPython" not in shown


def test_window_bounds_and_columns_reach_the_scan(spark):
    shown = plan(queries()["brewery_leaderboard"](spark, FOLDER))
    assert shown.count("l_shipdate#") and "GreaterThanOrEqual(l_shipdate,2000-07-05T00:00)" in shown
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in shown
    assert shown.count("FileScan parquet [l_") == 1  # both windows in one pass


def test_top_lists_are_cut_before_the_shuffle(spark):
    for name in ("brewery_leaderboard", "top_venues", "any_left_join_lookup", "dedup_keep_first", "latest_by_key"):
        shown = plan(queries()[name](spark, FOLDER))
        assert "WindowGroupLimit" in shown and "Partial" in shown
    assert "TakeOrderedAndProject" in plan(queries()["brewery_scatter"](spark, FOLDER))


def test_totals_are_combined_before_the_shuffle(spark):
    shown = plan(queries()["region_rating"](spark, FOLDER))
    assert shown.count("partial_sum") >= 2
    assert "partial_" in plan(queries()["dedup_drop_all"](spark, FOLDER))


def test_positions_do_not_gather_in_one_task(spark):
    df = spark.range(1000).withColumn("x", F.rand(1))
    shown = plan(ops.global_position(df, [F.col("x").asc(), F.col("id").asc()]).select("id", "position"))
    # The only single task adds up the partition sizes, one row per partition.
    assert shown.count("SinglePartition") == 1
    assert "output=[_part" in shown[shown.index("SinglePartition") :].split("\n")[1]


def test_ranks_are_not_gathered_by_group(large):
    df = large.range(1000).withColumn("g", F.col("id") % 2).withColumn("x", F.rand(1))
    lines = plan(ops.rank_within(df, ["g"], [F.col("x").asc(), F.col("id").asc()])).split("\n")
    assert sum("Scan ExistingRDD" in line for line in lines) == 2
    exchanges = [place for place, line in enumerate(lines) if "Exchange hashpartitioning(g#" in line]
    assert len(exchanges) == 1 and "HashAggregate" in lines[exchanges[0] + 1]  # sizes, not rows
    assert any("Exchange hashpartitioning(_part#" in line for line in lines)


def test_gaps_are_filled_in_one_pass(large):
    for name, table in (("panel_densified", "[o_"), ("missing_years", "[o_")):
        assert plan(queries()[name](large, FOLDER)).count(f"FileScan parquet {table}") == 1


def test_postings_are_not_shuffled_by_currency(large):
    shown = plan(queries()["salary_month_usd"](large, FOLDER))
    posting_exchanges = [line for line in shown.split("\n") if "hashpartitioning(salary_currency" in line]
    assert len(posting_exchanges) <= 1 and "BroadcastHashJoin [salary_currency" in shown  # that of the rates


def test_stored_keys_are_distinct_before_the_join(large):
    shown = plan(queries()["anti_join_new_keys"](large, FOLDER))
    join = shown[shown.index("LeftAnti"):]
    assert "HashAggregate" in join and "value" in join


def test_limited_views_sort_only_the_top(spark):
    board = spark.createDataFrame(
        [(1, 5, "b", "w", 3.5, "–")], "rank bigint, checkins bigint, beer_name string, brewery_name string, avg_rating double, movement string"
    )
    from barrelbook.plans.leaderboards import beers_view

    shown = plan(beers_view(board, 1, 10))
    assert "TakeOrdered" in shown or "WindowGroupLimit" in shown


def test_bounded_results_keep_their_order_after_shuffled_joins(large):
    means = [r["brewery_pure_average"] for r in queries()["brewery_scatter"](large, "/root/testdata/sf0.01").collect()]
    assert len(means) > 5 and means == sorted(means, reverse=True)
    ranks = [r["rank"] for r in queries()["brewery_leaderboard"](large, "/root/testdata/sf0.01").collect()]
    assert ranks == list(range(1, 26))
    panel = [(r["name"], r["year"]) for r in queries()["price_panel"](large, FOLDER).collect()]
    assert panel == sorted(panel)
