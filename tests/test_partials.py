"""Stored days, bit masks of levels and medians of any size against their plain definitions."""

from __future__ import annotations

import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barrelbook.operators import levels, partials, periods, quantiles
from barrelbook.session import scratch_path

KEYS_DDL = "beer_id bigint, brewery_id bigint"
KEYS = ["beer_id", "brewery_id"]
DDL = f"{KEYS_DDL}, rating_score double, created_at timestamp_ntz"
AS_OF = date(2021, 1, 31)


@pytest.fixture(scope="module")
def checkins(spark):
    pick = random.Random(5)
    start = datetime(2020, 12, 20)
    rows = [(None, 1, 4.0, start), (1, None, None, datetime(2021, 1, 21)), (1, 1, 3.0, None)]
    for _ in range(3000):
        moment = start + timedelta(days=pick.randrange(45), seconds=pick.choice([0, 0, 1, 50_000, 86_399]))
        rows.append((pick.randrange(12), pick.randrange(4), pick.choice([None, 0.25, 3.5, 3.75, 5.0]), moment))
    return spark.createDataFrame(rows, DDL)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(*sorted(frame.columns)).collect()), key=str)


def test_windows_of_stored_days_equal_windows_of_checkins(spark, checkins):
    path = scratch_path(spark, "days")
    partials.store_days(checkins, path, KEYS, "2020-12-20", "2021-02-05")
    stored = partials.read_days(spark, path, KEYS_DDL)
    for as_of, days, before in (("2021-01-31", 10, 10), ("2021-01-20", 7, 3), ("2020-12-25", 30, 30), ("2022-01-01", 5, 5)):
        window = (KEYS, as_of, days, before)
        assert rows_of(partials.two_window_totals_of_days(stored, *window)) == rows_of(periods.two_window_totals(checkins, *window))
        window = (KEYS[1:], as_of, days)
        assert rows_of(partials.trailing_totals_of_days(stored, *window)) == rows_of(periods.trailing_totals(checkins, *window))


def test_a_day_is_added_from_its_own_checkins_and_replaced_whole(spark, checkins):
    path = scratch_path(spark, "days")
    today = F.to_date("created_at") == AS_OF
    partials.store_days(checkins, path, KEYS, "2020-12-20", AS_OF - timedelta(days=1))
    half = checkins.filter(today & (F.col("beer_id") < 6))
    partials.store_days(half, path, KEYS, AS_OF)
    partials.store_days(checkins.filter(today), path, KEYS, AS_OF)  # late rows: the day once more
    window = (KEYS, AS_OF, 10, 10)
    stored = partials.read_days(spark, path, KEYS_DDL)
    assert rows_of(partials.two_window_totals_of_days(stored, *window)) == rows_of(periods.two_window_totals(checkins, *window))


def test_the_job_of_a_day_reads_that_day(spark, checkins):
    path, days = scratch_path(spark, "checkins"), scratch_path(spark, "days")
    checkins.write.parquet(path)
    facts = spark.read.schema(DDL).parquet(path)
    inside = partials.day_partials(
        facts.filter((F.col("created_at") >= periods.as_day(AS_OF)) & (F.col("created_at") < F.date_add(periods.as_day(AS_OF), 1))), KEYS
    )
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at,2021-01-31T00:00)" in plan and "LessThan(created_at,2021-02-01T00:00)" in plan
    partials.store_days(facts, days, KEYS, AS_OF)
    stored = partials.read_days(spark, days, KEYS_DDL)
    assert [r.day for r in stored.select("day").distinct().collect()] == [AS_OF]
    plan = partials.trailing_totals_of_days(stored, KEYS, AS_OF, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


@pytest.mark.parametrize("step", [0.25, 0.5, 1.0])
def test_masks_count_and_sum_distinct_values(spark, step):
    pick = random.Random(6)
    values = [None, 0.0, 0.25, 0.5, 3.75, 15.75, 16.0, 31.5, 62.0, 63.0, 1000.5, -1.0, 0.1, 3.3, 1e12, float(1 << 40)]
    rows = [(pick.choice([1, 2, None]), pick.choice(values)) for _ in range(400)] + [(3, None), (4, 63.0), (4, 63.0)]
    facts = spark.createDataFrame(rows, "k bigint, v double")
    masks = levels.level_masks(facts, ["k"], "v", step)
    found = masks.groupBy("k").agg(F.sum(levels.mask_count()).alias("n"), F.sum(levels.mask_sum(step)).alias("total"))
    for row in found.collect():
        own = {v for k, v in rows if k == row.k and v is not None}
        assert row.n == len(own)
        assert row.total is None if not own else row.total == pytest.approx(sum(own), rel=1e-12)


def test_medians_as_defined(spark):
    pick = random.Random(7)
    columns = {
        "ties": [pick.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(5000)],
        "wide": [pick.choice([-1, 1]) * 10.0 ** pick.randint(-200, 200) for _ in range(5000)],
        "one": [4.0] * 5000,
        "gaps": [None if i % 3 else float(pick.randrange(10**9)) for i in range(5000)],
        "halves": [float(i % 2 * 10) for i in range(5000)],
    }
    frame = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(5)
    row = quantiles.exact_medians(frame, list(columns), few=50, accuracy=200).first()
    for name, values in columns.items():
        kept = sorted(v for v in values if v is not None)
        low, high = statistics.median_low(kept), statistics.median_high(kept)
        assert row[name] == low + (high - low) / 2, name
    assert quantiles.exact_median(frame.limit(0), "ties") is None
    for nth in (0, 17, 4998, 4999):
        assert quantiles.order_statistic(frame, "wide", nth, 5000, 100, 10) == sorted(columns["wide"])[nth]
