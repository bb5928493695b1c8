"""Country-year price panel and its animation frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import or_zero, ratio
from ..operators.dedup import keep_first
from ..operators.joins import lookup_exactly_one
from ..operators.panel import attach_years, densify

# Years of the panel, countries left out, names in the yearly tables.
FIRST_YEAR, LAST_YEAR = 2005, 2019
EXCLUDED_COUNTRIES = ("Taiwan", "United Arab Emirates", "Venezuela")
COUNTRY_ALIASES = {
    "Russian Federation": "Russia",
    "Egypt, Arab Rep.": "Egypt",
    "Hong Kong SAR, China": "Hong Kong",
    "United Kingdom": "Britain",
    "Korea, Rep.": "South Korea",
    "United Arab Emirates": "UAE",
    "Venezuela, RB": "Venezuela",
    "Slovak Republic": "Slovakia",
}
DEFAULT_CONTINENT = "Europe"
MARKER_SCALE = 20000000


def yearly_prices(prices: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """The first quote of every country and year, in dollars."""
    day = F.col("date")
    inside = (day >= F.lit(f"{first_year}-01-01").cast("date")) & (
        day < F.lit(f"{last_year + 1}-01-01").cast("date")
    )
    quotes = prices.select("name", "local_price", "dollar_ex", "iso_a3", "date").filter(inside)
    first = keep_first(quotes.withColumn("year", F.year("date")), ["year", "name"], ["date"])
    return first.select("name", "year", "iso_a3", ratio(F.col("local_price"), F.col("dollar_ex")).alias("dollar_price"))


def with_continent(panel: DataFrame, continents: DataFrame) -> DataFrame:
    """Continent by three-letter code; codes on no or on several continents get the default."""
    codes = continents.select(
        F.col("Three_Letter_Country_Code").alias("iso_a3"), F.col("Continent_Name").alias("continent")
    )
    return lookup_exactly_one(panel, codes, "iso_a3", ["continent"], {"continent": DEFAULT_CONTINENT})


def price_panel(
    prices: DataFrame,
    continents: DataFrame,
    population: DataFrame,
    gdp: DataFrame,
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
    excluded: Sequence[str] = EXCLUDED_COUNTRIES,
    aliases: Mapping[str, str] = COUNTRY_ALIASES,
) -> DataFrame:
    """One row per country and year with price, population and GDP; missing values are 0.

    ``prices``: name, local_price, dollar_ex, iso_a3, date. ``population`` and ``gdp``:
    ``Country Name`` and one column per year.
    """
    wanted = prices.filter(~F.col("name").isin(list(excluded))) if excluded else prices
    located = with_continent(yearly_prices(wanted, first_year, last_year), continents).drop("iso_a3")
    panel = densify(located, ["name"], "year", first_year, last_year, {"dollar_price": 0.0}, carry=["continent"])
    years = range(first_year, last_year + 1)
    for measure, wide in (("population", population), ("gdp", gdp)):
        named = wide.replace(dict(aliases), subset=["Country Name"]) if aliases else wide
        panel = attach_years(panel, named.withColumnRenamed("Country Name", "name"), "name", years, "year", measure)
    per_capita = ratio(F.col("gdp"), F.col("population"))
    return panel.select(
        "name",
        "year",
        "continent",
        or_zero(F.col("dollar_price")).alias("dollar_price"),
        or_zero(F.col("population")).alias("population"),
        or_zero(F.col("gdp")).alias("gdp"),
        or_zero(per_capita).alias("gdp_per_capita"),
    ).orderBy("name", "year")


def motion_frames(panel: DataFrame) -> DataFrame:
    """Per year and continent the marker arrays, ordered by country name. A frame holds at
    most one point per country."""
    point = F.struct(
        "name",
        "population",
        "gdp_per_capita",
        (F.col("dollar_price") * F.lit(MARKER_SCALE)).alias("size"),
        F.bround("dollar_price", 1).alias("price_label"),
    )
    frames = panel.groupBy("year", "continent").agg(F.array_sort(F.collect_list(point)).alias("points"))
    return frames.select(
        "year",
        "continent",
        F.col("points.population").alias("x"),
        F.col("points.gdp_per_capita").alias("y"),
        F.col("points.name").alias("text"),
        F.col("points.size").alias("size"),
        F.col("points.price_label").alias("customdata"),
    )
