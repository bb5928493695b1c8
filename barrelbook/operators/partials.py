"""Totals per day, stored once, and windows put together from them.

A day's row holds the sum, the number of rated rows and the number of rows per key, and the same
for the first instant of the day alone: two windows share that instant (see ``periods``). Sums are
exact, and windows equal those over the facts, as long as the measure is a multiple of a power of
two, such as whole or quarter points.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .periods import BEFORE, NOW, as_day

DAY = "day"
PARTS = ("total", "checkins", "rows")


def day_partials(
    facts: DataFrame, keys: Sequence[str], moment: str = "created_at", measure: str = "rating_score"
) -> DataFrame:
    """One row per key and day, from one pass over the facts. Facts without a moment are left out."""
    first = F.col(moment) == F.date_trunc("day", moment)
    score = F.col(measure)
    sums = [
        F.sum(score).alias("total"),
        F.count(score).alias("checkins"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(first, score)).alias("first_total"),
        F.count(F.when(first, score)).alias("first_checkins"),
        F.count(F.when(first, F.lit(1))).alias("first_rows"),
    ]
    dated = facts.filter(F.col(moment).isNotNull()).withColumn(DAY, F.to_date(moment))
    return dated.groupBy(DAY, *keys).agg(*sums)


def store_days(
    facts: DataFrame,
    path: str,
    keys: Sequence[str],
    first: str | date,
    last: str | date | None = None,
    moment: str = "created_at",
    measure: str = "rating_score",
) -> None:
    """Store the partials of some days, a folder each; the folders of other days stay as they are.

    The bounds reach the scan of the facts, so a day's job reads that day. A day that is stored
    again is replaced; rows that came late are added by storing their day again.
    """
    at = F.col(moment)
    inside = facts.filter((at >= as_day(first)) & (at < F.date_add(as_day(first if last is None else last), 1)))
    rows = day_partials(inside, keys, moment, measure).hint("rebalance", DAY)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def read_days(spark, path: str, keys_ddl: str) -> DataFrame:
    """Stored partials; ``keys_ddl`` names and types the keys."""
    parts = ", ".join(f"{p}total double, {p}checkins bigint, {p}rows bigint" for p in ("", "first_"))
    return spark.read.schema(f"{keys_ddl}, {parts}, {DAY} date").parquet(path)


def _sum(condition: Column, part: str, name: str) -> Column:
    total = F.sum(F.when(condition, F.col(part)))
    return (total if name.endswith("total") else F.coalesce(total, F.lit(0))).alias(name)


def two_window_totals_of_days(
    partials: DataFrame, keys: Sequence[str], as_of: str | date, days: int, previous_days: int
) -> DataFrame:
    """What ``two_window_totals`` gives over the facts. Folders of other days are not read."""
    day, start = F.col(DAY), F.date_sub(as_day(as_of), days)
    begin = F.date_sub(as_day(as_of), days + previous_days)
    scoped = partials.filter((day >= begin) & (day <= as_day(as_of)))
    now, before, shared = day >= start, day < start, day == start
    sums = [_sum(now, part, f"{NOW}_{part}") for part in PARTS]
    for part in PARTS:
        value = F.when(before, F.col(part)).when(shared, F.col(f"first_{part}"))
        total = F.sum(value)
        sums.append((total if part == "total" else F.coalesce(total, F.lit(0))).alias(f"{BEFORE}_{part}"))
    return scoped.groupBy(*keys).agg(*sums)


def trailing_totals_of_days(partials: DataFrame, keys: Sequence[str], as_of: str | date, days: int) -> DataFrame:
    """What ``trailing_totals`` gives over the facts."""
    day = F.col(DAY)
    recent = partials.filter((day >= F.date_sub(as_day(as_of), days)) & (day <= as_day(as_of)))
    return recent.groupBy(*keys).agg(F.sum("total").alias("total"), F.coalesce(F.sum("checkins"), F.lit(0)).alias("checkins"))
