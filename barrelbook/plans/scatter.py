"""Rating against volume per brewery, with classes and medians for the chart."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import age_class, days_to_years, ratio, size_class
from ..functions.text import marker_label, median_label, short_marker_label
from ..operators.joins import any_left_join, dict_lookup
from ..operators.periods import in_trailing_window, trailing_totals

# Captions of the short labels, by language.
PRODUCT_CAPTIONS = {"short": "количество сортов пива", "short_en": "Beer range"}


def brewery_means(
    reviews: DataFrame, as_of: str | date, days: int, totals_of: Callable[..., DataFrame] = trailing_totals
) -> DataFrame:
    """Mean and number of ratings per brewery in the trailing window. ``reviews`` are what
    ``totals_of`` adds up: check-ins, or stored days of them.

    The mean over all ratings equals the sum over beers of (beer total / brewery count),
    see ``share_sum_means``; one pass and one shuffle instead of two of each.
    """
    totals = totals_of(reviews, ["brewery_id"], as_of, days)
    return totals.select(
        "brewery_id",
        ratio(F.col("total"), F.col("checkins")).alias("brewery_pure_average"),
        F.col("checkins").alias("rating_count"),
    )


def share_sum_means(reviews: DataFrame, as_of: str | date, days: int) -> DataFrame:
    """The same mean in its two-level form: each beer adds its share of the brewery."""
    recent = reviews.filter(in_trailing_window(F.col("created_at"), as_of, days))
    beers = recent.groupBy("beer_id", "brewery_id").agg(
        F.sum("rating_score").alias("_total"), F.count("rating_score").alias("_count")
    )
    breweries = beers.groupBy("brewery_id").agg(F.sum("_count").alias("rating_count"))
    shares = beers.join(breweries, "brewery_id").withColumn(
        "_share", ratio(F.col("_total"), F.col("rating_count"))
    )
    return shares.groupBy("brewery_id", "rating_count").agg(F.sum("_share").alias("brewery_pure_average"))


def brewery_scatter(
    reviews: DataFrame,
    breweries: DataFrame,
    brewery_info: DataFrame,
    as_of: str | date,
    days: int = 30,
    top_n: int = 100,
    min_count: int = 150,
    ascending: bool = False,
    label: str = "full",
    totals_of: Callable[..., DataFrame] = trailing_totals,
) -> DataFrame:
    """The ``top_n`` best (or worst) breweries with enough ratings, described. ``label`` is
    ``full``, ``short`` or ``short_en``.

    Descriptions are attached to the ``top_n`` rows only. ``breweries`` has brewery_id,
    brewery_name, beer_count; ``brewery_info`` has brewery_id, stats_age_on_service (days).
    A brewery without info counts as new (age 0).
    """
    means = brewery_means(reviews, as_of, days, totals_of).filter(F.col("rating_count") >= min_count)
    mean = F.col("brewery_pure_average")
    order = [mean.asc_nulls_last() if ascending else mean.desc_nulls_last(), F.col("brewery_id").asc()]
    top = means.orderBy(*order).limit(top_n)
    described = dict_lookup(
        top,
        breweries.select("brewery_id", "brewery_name", "beer_count"),
        "brewery_id",
        {"brewery_name": "", "beer_count": 0},
    )
    described = any_left_join(
        described,
        brewery_info.select("brewery_id", "stats_age_on_service"),
        "brewery_id",
        defaults={"stats_age_on_service": 0},
    )
    named = described.withColumn("age_on_service", days_to_years(F.col("stats_age_on_service"))).withColumn(
        "beer_count", F.col("beer_count").cast("bigint")
    )
    name, products = F.col("brewery_name"), F.col("beer_count")
    text = (
        marker_label(name, products, F.col("rating_count"), mean)
        if label == "full"
        else short_marker_label(name, products, PRODUCT_CAPTIONS[label])
    )
    return named.select(
        "brewery_id",
        "brewery_pure_average",
        "rating_count",
        "brewery_name",
        "beer_count",
        "age_on_service",
        text.alias("name_count"),
        size_class(F.col("beer_count")).alias("bucket_beer_count"),
        age_class(F.col("age_on_service")).alias("bucket_age"),
    ).orderBy(*order)


def with_medians(scatter: DataFrame) -> DataFrame:
    """The scatter with the median mean and median count on every row. The frame is
    bounded by its ``top_n``, hence the single window."""
    everything = W.partitionBy(F.lit(0))
    return scatter.withColumn(
        "median_average", F.median("brewery_pure_average").over(everything)
    ).withColumn("median_count", F.median("rating_count").over(everything))


def scatter_medians(scatter: DataFrame) -> DataFrame:
    """One row with both exact medians of a bounded scatter, and the texts beside them."""
    medians = scatter.agg(
        F.median("brewery_pure_average").alias("median_average"),
        F.median("rating_count").alias("median_count"),
    )
    return medians.select(
        "*",
        median_label(F.col("median_average")).alias("average_label"),
        median_label(F.col("median_count")).alias("count_label"),
    )
