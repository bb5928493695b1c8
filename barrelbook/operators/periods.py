"""Windows relative to an explicit ``as_of`` day, and totals for two of them at once."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOW = "now"
BEFORE = "before"


def as_day(as_of: str | date) -> Column:
    return F.lit(date.fromisoformat(as_of) if isinstance(as_of, str) else as_of)


def in_trailing_window(moment: Column, as_of: str | date, days: int) -> Column:
    """From ``days`` before ``as_of`` to the end of ``as_of``."""
    day = as_day(as_of)
    return (moment >= F.date_sub(day, days)) & (moment < F.date_add(day, 1))


def in_previous_window(moment: Column, as_of: str | date, days: int, previous_days: int) -> Column:
    """The window before the trailing one; both ends belong to it, so the first
    instant of the trailing window counts in both."""
    day = as_day(as_of)
    return moment.between(F.date_sub(day, days + previous_days), F.date_sub(day, days))


def two_window_totals(
    facts: DataFrame,
    keys: Sequence[str],
    as_of: str | date,
    days: int,
    previous_days: int,
    moment: str = "created_at",
    measure: str = "rating_score",
) -> DataFrame:
    """Sum, non-NULL count and row count of ``measure`` per key, for both windows,
    in a single pass over the facts."""
    at, score = F.col(moment), F.col(measure)
    now = in_trailing_window(at, as_of, days)
    before = in_previous_window(at, as_of, days, previous_days)
    day = as_day(as_of)
    scoped = facts.filter((at >= F.date_sub(day, days + previous_days)) & (at < F.date_add(day, 1)))
    aggregates = []
    for label, condition in ((NOW, now), (BEFORE, before)):
        aggregates += [
            F.sum(F.when(condition, score)).alias(f"{label}_total"),
            F.count(F.when(condition, score)).alias(f"{label}_checkins"),
            F.count(F.when(condition, F.lit(1))).alias(f"{label}_rows"),
        ]
    return scoped.groupBy(*keys).agg(*aggregates)


def trailing_totals(
    facts: DataFrame,
    keys: Sequence[str],
    as_of: str | date,
    days: int,
    moment: str = "created_at",
    measure: str = "rating_score",
) -> DataFrame:
    """Sum and non-NULL count of ``measure`` per key in the trailing window."""
    recent = facts.filter(in_trailing_window(F.col(moment), as_of, days))
    return recent.groupBy(*keys).agg(F.sum(measure).alias("total"), F.count(measure).alias("checkins"))


def merge_totals(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Roll finer two-window totals up to ``keys``."""
    columns = [f"{label}_{part}" for label in (NOW, BEFORE) for part in ("total", "checkins", "rows")]
    return totals.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def window_rows(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two-window totals as one row per key and window in which the key occurs,
    with the mean. A key without any rated row keeps a NULL mean."""
    sides = [
        F.struct(
            F.lit(label).alias("window"),
            F.col(f"{label}_total").alias("total"),
            F.col(f"{label}_checkins").alias("checkins"),
            F.col(f"{label}_rows").alias("rows"),
        )
        for label in (NOW, BEFORE)
    ]
    return (
        totals.select(*keys, F.inline(F.array(*sides)))
        .filter(F.col("rows") > 0)
        .select(*keys, "window", F.try_divide("total", "checkins").alias("mean"), "checkins", "rows")
    )
