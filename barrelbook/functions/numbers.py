"""Rounding, missing numbers, ratios, size classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_zero(value: Column) -> Column:
    """NULL and NaN as 0."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def round_even(value: Column, digits: int = 2) -> Column:
    """Round half to even."""
    return F.bround(value, digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient; NULL where the denominator is 0 or either side is missing."""
    return F.try_divide(numerator, denominator)


def days_to_years(days: Column) -> Column:
    return days / F.lit(365)


def size_class(count: Column) -> Column:
    """Marker size by number of products: below 10, 10-30, 31-50, above."""
    return (
        F.when(count < 10, 7)
        .when(count.between(10, 30), 9)
        .when(count.between(31, 50), 11)
        .otherwise(13)
        .cast("bigint")
    )


def age_class(years: Column) -> Column:
    """Class by years on the service: below 4, 4 to 6, above 6 and below 8, the rest."""
    return (
        F.when(years < 4, 0)
        .when(years.between(4, 6), 1)
        .when((years > 6) & (years < 8), 2)
        .otherwise(3)
        .cast("bigint")
    )


def parse_decimal_comma(text: Column) -> Column:
    """``3,7`` as a double; NULL if the text is no number."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def format_decimal_comma(value: Column) -> Column:
    """A number as text with a decimal comma."""
    return F.replace(value.cast("string"), F.lit("."), F.lit(","))


def flag(condition: Column) -> Column:
    """A boolean as 0/1, keeping NULL."""
    return condition.cast("int")


def present(value: Column) -> Column:
    """1 if the value is there, else 0."""
    return value.isNotNull().cast("int")
