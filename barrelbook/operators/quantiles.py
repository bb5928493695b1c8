"""Exact order statistics of any number of values, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Accuracy of the mergeable sketches, and the rows left that are sorted at last.
ACCURACY, FEW = 10_000, 10_000


def order_statistic(values: DataFrame, column: str, nth: int, count: int, accuracy: int = ACCURACY, few: int = FEW):
    """The ``nth`` smallest of ``count`` values, from 0. NULL and NaN are no values.

    Two approximate quantiles enclose it; counts tell where it lies, and the values strictly
    between them are the input of the next round. A round leaves about four in ``accuracy`` of the
    rows, and fewer if values repeat, so few rounds do. Only counts and borders reach the driver.
    """
    x = F.col(column)
    rest, below = values.select(x).filter(x.isNotNull() & ~F.isnan(x.cast("double"))), 0
    while count > few:
        share, margin = (nth - below) / count, 2 / accuracy
        low, high = rest.agg(
            F.percentile_approx(x, [max(0.0, share - margin), min(1.0, share + margin)], accuracy)
        ).first()[0]
        parts = rest.agg(
            *[F.count(F.when(c, 1)) for c in (x < low, x == low, (x > low) & (x < high), (x == high) & (x > low))]
        ).first()
        at, place = nth - below, 0
        for number, size in enumerate((*parts, count - sum(parts))):
            if at < place + size:
                break
            place += size
        if number in (1, 3):
            return low if number == 1 else high
        inside = {0: x < low, 2: (x > low) & (x < high), 4: x > high}[number]
        rest, below, count = rest.filter(inside), below + place, size
    return rest.orderBy(x).offset(nth - below).limit(1).first()[0]


def exact_median(values: DataFrame, column: str, **limits: int) -> float | None:
    """The middle value, or the mean of the two middle ones; None without values."""
    x = F.col(column)
    count = values.select(F.count(F.when(~F.isnan(x.cast("double")), x))).first()[0]
    if not count:
        return None
    low = order_statistic(values, column, (count - 1) // 2, count, **limits)
    high = low if count % 2 else order_statistic(values, column, count // 2, count, **limits)
    return float(low) + (float(high) - float(low)) / 2


def exact_medians(values: DataFrame, columns: list[str], **limits: int) -> DataFrame:
    """One row with the medians of several columns."""
    found = [exact_median(values, c, **limits) for c in columns]
    return values.sparkSession.createDataFrame([tuple(found)], ", ".join(f"`{c}` double" for c in columns))
