"""Product catalogue: cleaning, found product pages, union of two batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import format_decimal_comma, parse_decimal_comma
from ..functions.text import strip_newlines, transliterate
from ..operators.dedup import keep_first
from ..operators.joins import any_left_join, anti_join
from ..sources.html import extract_items

# Markup of a result page and, for the price of an offer, of a product page.
PRODUCT_FIELDS = {
    "find": ("span", "bold", None),
    "rating_text": ("div", "average__number", None),
    "count_text": ("p", "text-micro", None),
    "price_text": ("span", "wine-price-value", None),
}
OFFER_FIELDS = {
    "offer_text": ("span", "purchaseAvailabilityPPC__amount--2_4GT", None),
}
COUNT_SUFFIX = " ratings"


def clean_names(catalogue: DataFrame) -> DataFrame:
    """Names without line breaks."""
    return catalogue.withColumn("vine", strip_newlines(F.col("vine")))


def latin_names(catalogue: DataFrame) -> DataFrame:
    """Named rows only, with the names in Latin letters."""
    return catalogue.dropna(subset=["vine"]).withColumn("vine", transliterate(F.col("vine")))


def after_first(df: DataFrame, order: list[Column], rows: int, keys: list[str]) -> DataFrame:
    """Everything after the first ``rows`` rows under ``order``; ``keys`` tell rows apart.

    Each task forwards at most ``rows`` rows; the others are neither sorted nor moved by order.
    """
    return anti_join(df, df.orderBy(*order).limit(rows), keys)


def product_details(pages: DataFrame, offers: DataFrame) -> DataFrame:
    """What a search found: name, rating, number of ratings, average price.

    ``pages`` (vine, html) are the result pages, ``offers`` (vine, html) the product pages opened
    from them. A result without a price takes that of the offer on its product page.
    """
    results = extract_items(pages, "html", PRODUCT_FIELDS, ["vine"]).drop("position")
    offered = extract_items(offers, "html", OFFER_FIELDS, ["vine"]).drop("position")
    found = any_left_join(results, offered, "vine")
    count = F.replace(strip_newlines(F.col("count_text")), F.lit(COUNT_SUFFIX), F.lit(""))
    price = parse_decimal_comma(F.translate(F.col("price_text"), "\n ", ""))
    offer = F.col("offer_text").substr(F.lit(1), F.length("offer_text") - 1).try_cast("double")
    return found.select(
        "vine",
        strip_newlines(F.col("find")).alias("find"),
        parse_decimal_comma(strip_newlines(F.col("rating_text"))).alias("rating"),
        F.replace(count, F.lit(","), F.lit("")).try_cast("bigint").alias("ratings_count"),
        F.coalesce(price, offer).alias("avg_price"),
    )


def enriched(catalogue: DataFrame, details: DataFrame) -> DataFrame:
    """Catalogue rows with what was found for their name, numbers as decimal-comma text.
    ``row`` is the position in the file."""
    joined = catalogue.join(keep_first(details, ["vine"]), "vine")
    return joined.select(
        "row",
        F.col("vine").alias("name"),
        "find",
        format_decimal_comma(F.col("rating")).alias("rating"),
        format_decimal_comma(F.col("avg_price")).alias("avg_price"),
        format_decimal_comma(F.col("ratings_count")).alias("ratings_count"),
        "liter",
        "cost",
    )


def single_finds(rows: DataFrame) -> DataFrame:
    """The first row, in file order, of every found product."""
    return keep_first(rows, ["find"], ["row"])


def catalogue_summary(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of the first batch and the single finds of the second."""
    return first.unionByName(single_finds(second))
