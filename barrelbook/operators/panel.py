"""Key-by-year panels: gaps, densification, wide yearly tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _with_gaps(
    df: DataFrame, keys: Sequence[str], axis: str, first: int, last: int, carry: Sequence[str] = ()
) -> DataFrame:
    """Every row inside ``first..last`` and a row for every step that its key lacks there.

    One pass: each row, in the order of the axis, gives the gap before it, itself, and, as the
    last one of its key, the gap after it. ``_step`` is the axis value, ``_real`` tells rows from
    gaps, ``_first_…`` are the ``carry`` columns of the key's earliest row.
    """
    order = W.partitionBy(*keys).orderBy(F.col(axis).asc_nulls_last())
    at = F.coalesce(F.col(axis).cast("bigint"), F.lit(last + 1))
    seen = df.withColumns(
        {
            "_at": at,
            "_from": F.coalesce(F.lag(at).over(order) + 1, F.lit(first)),
            "_last": F.lead(at).over(order).isNull(),
            **{f"_first_{c}": F.first(c).over(order) for c in carry},
        }
    )
    nothing = F.array().cast("array<bigint>")

    def steps(low: Column, high: Column) -> Column:
        low, high = F.greatest(low, F.lit(first).cast("bigint")), F.least(high, F.lit(last).cast("bigint"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(nothing)

    before = steps(F.col("_from"), F.col("_at") - 1)
    itself = steps(F.col("_at"), F.col("_at"))
    after = F.when(F.col("_last"), steps(F.col("_at") + 1, F.lit(last).cast("bigint"))).otherwise(nothing)
    return seen.withColumn("_step", F.explode(F.concat(before, itself, after))).withColumn(
        "_real", F.col("_step") == F.col("_at")
    )


def densify(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    first: int,
    last: int,
    fill: Mapping[str, object],
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per key and ``axis`` value in ``first..last``. Gaps take the constants of
    ``fill``; ``carry`` columns take the value of the key's earliest row. The input is read once."""
    full = _with_gaps(df, keys, axis, first, last, carry)

    def value(name: str) -> Column:
        if name in keys:
            return F.col(name)
        if name == axis:
            return F.col("_step").cast(df.schema[axis].dataType).alias(axis)
        own = F.when(F.col("_real"), F.col(name))
        if name in fill:
            own = F.coalesce(own, F.lit(fill[name]))
        if name in carry:
            own = F.coalesce(own, F.col(f"_first_{name}"))
        return own.alias(name)

    return full.select(*[value(c) for c in df.columns])


def missing_keys(df: DataFrame, keys: Sequence[str], axis: str, first: int, last: int) -> DataFrame:
    """The key and axis pairs of the full domain that ``df`` lacks."""
    present = df.select(*keys, axis).distinct()
    gaps = _with_gaps(present, keys, axis, first, last).filter(~F.col("_real"))
    return gaps.select(*keys, F.col("_step").cast(df.schema[axis].dataType).alias(axis))


def unpivot_years(wide: DataFrame, key: str, years: Sequence[int], axis: str, value: str) -> DataFrame:
    """One row per key and year from a table with one column per year."""
    columns = [str(y) for y in years]
    long = wide.unpivot(key, [F.col(f"`{c}`").cast("double").alias(c) for c in columns], axis, value)
    return long.withColumn(axis, F.col(axis).cast("int"))


def attach_years(
    panel: DataFrame, wide: DataFrame, key: str, years: Sequence[int], axis: str, value: str
) -> DataFrame:
    """Attach a measure kept as one column per year, by key and year."""
    long = unpivot_years(wide, key, years, axis, value)
    return panel.join(long.withColumn(axis, F.col(axis).cast(panel.schema[axis].dataType)), [key, axis], "left")
