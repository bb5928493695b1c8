"""Brewery, city, beer and venue leaderboards with rank movement.

Common shape: one pass over both windows, aggregated before any join, so the facts
are shuffled once as partial sums. Expected columns:

- ``reviews``: beer_id, brewery_id, venue_id, rating_score, created_at
- ``venues``: venue_id, venue_city, venue_country (and venue_name for ``top_venues``)
- ``breweries``: brewery_id, brewery_name
- ``beers``: beer_id, beer_name, beer_style

``totals_of`` adds up the reviews: ``two_window_totals`` over check-ins, or
``two_window_totals_of_days`` over stored days of them (see ``operators.partials``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import or_zero, round_even
from ..operators.dedup import drop_repeated_keys, keep_first
from ..operators.joins import any_left_join, dict_lookup, semi_join
from ..operators.periods import BEFORE, NOW, merge_totals, two_window_totals, window_rows
from ..operators.ranking import rank_change, rank_within, top_k_within, trophy, with_previous_rank

# Venue city spellings and the city they mean.
CITY_ALIASES = {
    "Moskva": "Москва",
    "Moscow": "Москва",
    "СПБ": "Санкт-Петербург",
    "Saint Petersburg": "Санкт-Петербург",
    "St Petersburg": "Санкт-Петербург",
    "Nizhnij Novgorod": "Нижний Новгород",
    "Tula": "Тула",
    "Nizhniy Novgorod": "Нижний Новгород",
}

# Cities with a board, and the second spelling each board accepts.
BOARD_CITIES = {
    "Москва": "Moscow",
    "Сергиев Посад": "Sergiev Posad",
    "Санкт-Петербург": "Saint Petersburg",
    "Владимир": "Vladimir",
    "Красная Пахра": "Red Pakhra",
    "Воронеж": "Voronezh",
    "Екатеринбург": "Yekaterinburg",
    "Ярославль": "Yaroslavl",
    "Казань": "Kazan",
    "Ростов-на-Дону": "Rostov-on-Don",
    "Краснодар": "Krasnodar",
    "Тула": "Tula",
    "Курск": "Kursk",
    "Пермь": "Perm",
    "Нижний Новгород": "Nizhnij Novgorod",
}

# Column titles of the displayed boards.
BREWERY_TITLES = {
    "place": "МЕСТО",
    "brewery_name": "НАЗВАНИЕ",
    "venue_city": "ГОРОД",
    "avg_rating": "РЕЙТИНГ",
    "movement": "ИЗМЕНЕНИЕ",
    "checkins": "ЧЕКИНОВ",
}
BEER_TITLES = {
    "place": "МЕСТО",
    "beer_name": "СОРТ ПИВА",
    "brewery_name": "ПИВОВАРНЯ",
    "avg_rating": "РЕЙТИНГ",
    "movement": "ИЗМЕНЕНИЕ",
    "checkins": "ЧЕКИНОВ",
}

HOME_COUNTRY = "Россия"


def display(board: DataFrame, titles: Mapping[str, str]) -> DataFrame:
    """The board's columns under their display titles, in title order."""
    return board.select(*[F.col(c).alias(title) for c, title in titles.items() if c in board.columns])


def _best(*ids: str) -> list[Column]:
    return [F.col("mean").desc_nulls_last(), *[F.col(c).asc() for c in ids]]


def _worst(*ids: str) -> list[Column]:
    return [F.col("mean").asc_nulls_last(), *[F.col(c).asc() for c in ids]]


def _home_totals(
    reviews: DataFrame,
    venues: DataFrame,
    keys: list[str],
    as_of: str | date,
    days: int,
    previous_days: int,
    country: str,
    totals_of: Callable[..., DataFrame],
) -> DataFrame:
    """Totals per ``keys`` (brewery, venue city), inside the country.

    Check-ins are aggregated by (venue, brewery) first, which leaves a hot venue with one row
    per brewery when it meets the venue table. Adaptive execution chooses the kind of the join.
    """
    located = reviews.filter(F.col("venue_id").isNotNull())
    at_home = F.col("venue_country") == country
    places = venues.select("venue_id", "venue_city", "venue_country")
    home = keep_first(places, ["venue_id"]).filter(at_home).drop("venue_country")
    by_venue = totals_of(located, ["venue_id", "brewery_id"], as_of, days, previous_days)
    return merge_totals(by_venue.join(home, "venue_id"), keys)


def _move_within_top(ranked: DataFrame, key: str) -> DataFrame:
    """Current rows of two short top lists with the rank in the list before. At most one
    row per key and window exists here."""
    before = F.max(F.when(F.col("window") == BEFORE, F.col("rank"))).over(W.partitionBy(key))
    return ranked.withColumn("previous_rank", before).filter(F.col("window") == NOW).drop("window")


def _windows(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return ranked.filter(F.col("window") == NOW), ranked.filter(F.col("window") == BEFORE)


def brewery_ranks(
    reviews: DataFrame,
    venues: DataFrame,
    as_of: str | date,
    country: str = HOME_COUNTRY,
    days: int = 30,
    previous_days: int = 30,
    min_checkins: int = 250,
    k: int = 10,
    totals_of: Callable[..., DataFrame] = two_window_totals,
) -> DataFrame:
    """The top ``k`` breweries of each window, by mean rating."""
    totals = _home_totals(reviews, venues, ["brewery_id"], as_of, days, previous_days, country, totals_of)
    rated = window_rows(totals, ["brewery_id"]).filter(F.col("checkins") >= min_checkins)
    return top_k_within(rated, ["window"], _best("brewery_id"), k)


def brewery_leaderboard(
    reviews: DataFrame,
    venues: DataFrame,
    breweries: DataFrame,
    as_of: str | date,
    country: str = HOME_COUNTRY,
    days: int = 30,
    previous_days: int = 30,
    min_checkins: int = 250,
    k: int = 10,
    totals_of: Callable[..., DataFrame] = two_window_totals,
) -> DataFrame:
    """Top breweries of a country with their movement. Ranks are compared inside each
    window's own top ``k``, so a brewery that was below it before shows no movement."""
    ranked = brewery_ranks(reviews, venues, as_of, country, days, previous_days, min_checkins, k, totals_of)
    moved = _move_within_top(ranked, "brewery_id")
    named = dict_lookup(moved, breweries.select("brewery_id", "brewery_name"), "brewery_id", {"brewery_name": ""})
    return named.select(
        trophy(F.col("rank")).alias("place"),
        "brewery_id",
        "brewery_name",
        round_even(or_zero(F.col("mean"))).alias("avg_rating"),
        rank_change(F.col("previous_rank"), F.col("rank")).alias("movement"),
        "checkins",
        "rank",
        "previous_rank",
    ).orderBy("rank")


def city_leaderboard(
    reviews: DataFrame,
    venues: DataFrame,
    breweries: DataFrame,
    as_of: str | date,
    country: str = HOME_COUNTRY,
    days: int = 30,
    previous_days: int = 30,
    board_cities: Mapping[str, str] | None = BOARD_CITIES,
    totals_of: Callable[..., DataFrame] = two_window_totals,
) -> DataFrame:
    """Full brewery ranking of every board city in one job.

    ``board_cities`` maps a board to the second spelling it accepts; ``None`` makes every
    venue city a board of its own. A brewery listed under both spellings has two rows and,
    if that was so before, no previous rank.
    """
    totals = _home_totals(reviews, venues, ["venue_city", "brewery_id"], as_of, days, previous_days, country, totals_of)
    if board_cities is None:
        boards = totals.withColumn("board_city", F.col("venue_city"))
    else:
        spelled = {name: name for name in board_cities} | {v: name for name, v in board_cities.items()}
        boards = totals.filter(F.col("venue_city").isin(list(spelled))).withColumn(
            "board_city", F.col("venue_city")
        ).replace(spelled, subset=["board_city"])
    rated = window_rows(boards, ["board_city", "venue_city", "brewery_id"])
    ranked = rank_within(rated, ["window", "board_city"], _best("brewery_id", "venue_city"))
    now, before = _windows(ranked)
    moved = with_previous_rank(now, before, ["board_city", "brewery_id"])
    named = dict_lookup(moved, breweries.select("brewery_id", "brewery_name"), "brewery_id", {"brewery_name": ""})
    return named.select(
        "board_city",
        "brewery_id",
        "brewery_name",
        "venue_city",
        round_even(or_zero(F.col("mean"))).alias("avg_rating"),
        rank_change(F.col("previous_rank"), F.col("rank")).alias("movement"),
        "checkins",
        "rank",
    )


def city_leaderboard_view(
    board: DataFrame,
    city: str | None = None,
    min_checkins: int = 250,
    k: int = 10,
    aliases: Mapping[str, str] = CITY_ALIASES,
) -> DataFrame:
    """Displayed part of a stored city board: threshold, then common city names, then one
    row per brewery name and city, then the first ``k`` renumbered. All boards without
    ``city``."""
    rows = board if city is None else board.filter(F.col("board_city") == city)
    rows = rows.filter(F.col("checkins") >= min_checkins)
    rows = rows.replace(dict(aliases), subset=["venue_city"]) if aliases else rows
    single = keep_first(rows, ["board_city", "brewery_name", "venue_city"], ["rank"])
    single = single.withColumnRenamed("rank", "board_rank")
    shown = top_k_within(single, ["board_city"], [F.col("board_rank")], k)
    return shown.orderBy("board_city", "rank").select(
        "board_city",
        trophy(F.col("rank")).alias("place"),
        "brewery_name",
        "venue_city",
        "avg_rating",
        "movement",
        "checkins",
    )


def _beer_output(moved: DataFrame) -> DataFrame:
    return moved.select(
        "beer_id",
        "beer_name",
        "brewery_id",
        "brewery_name",
        round_even(F.col("mean")).alias("avg_rating"),
        rank_change(F.col("previous_rank"), F.col("rank")).alias("movement"),
        "checkins",
        "rank",
    )


def beer_totals(
    reviews: DataFrame,
    as_of: str | date,
    days: int = 30,
    previous_days: int = 30,
    totals_of: Callable[..., DataFrame] = two_window_totals,
) -> DataFrame:
    """Totals per beer and brewery in both windows, the input of both beer boards."""
    return totals_of(reviews, ["beer_id", "brewery_id"], as_of, days, previous_days)


def best_beers(
    totals: DataFrame, beers: DataFrame, breweries: DataFrame, styles: DataFrame | None = None
) -> DataFrame:
    """All beers of a known style, best first, with movement in the full ranking.

    Without ``styles`` every non-NULL style is known. The previous rank is looked up by
    beer alone: a beer that was listed under two breweries has none.
    """
    described = any_left_join(totals, beers.select("beer_id", "beer_name", "beer_style"), "beer_id")
    described = (
        described.filter(F.col("beer_style").isNotNull())
        if styles is None
        else semi_join(described, styles, "beer_style")
    )
    rated = window_rows(described, ["beer_id", "beer_name", "brewery_id"])
    ranked = rank_within(rated, ["window"], _best("beer_id", "brewery_id"))
    now, before = _windows(ranked)
    moved = with_previous_rank(now, before, ["beer_id"])
    named = dict_lookup(moved, breweries.select("brewery_id", "brewery_name"), "brewery_id", {"brewery_name": ""})
    return _beer_output(named)


def worst_beers(totals: DataFrame, beers: DataFrame, breweries: DataFrame) -> DataFrame:
    """All beers, worst first. Ranks are given before unnamed beers and beers with several
    rows (several names or breweries) are dropped, so they have gaps."""
    rated = window_rows(totals, ["beer_id", "brewery_id"])
    ranked = rank_within(rated, ["window"], _worst("beer_id", "brewery_id"))
    now, before = _windows(ranked)
    named = drop_repeated_keys(now.join(beers.select("beer_id", "beer_name"), "beer_id"), ["beer_id"])
    moved = with_previous_rank(named, before, ["beer_id"])
    titled = dict_lookup(moved, breweries.select("brewery_id", "brewery_name"), "brewery_id", {"brewery_name": ""})
    return _beer_output(titled)


def beers_view(board: DataFrame, min_checkins: int = 250, k: int = 10) -> DataFrame:
    """Displayed part of a stored beer board: the first ``k`` with enough check-ins,
    renumbered."""
    enough = board.filter(F.col("checkins") >= min_checkins).withColumnRenamed("rank", "board_rank")
    shown = top_k_within(enough, [], [F.col("board_rank")], k)
    return shown.orderBy("rank").select(
        trophy(F.col("rank")).alias("place"), "beer_name", "brewery_name", "avg_rating", "movement", "checkins"
    )


def beer_styles(beers: DataFrame) -> DataFrame:
    """The distinct styles."""
    return beers.select("beer_style").distinct()


def top_venues(
    reviews: DataFrame,
    venues: DataFrame,
    as_of: str | date,
    country: str | None = HOME_COUNTRY,
    days: int = 30,
    previous_days: int = 30,
    k: int = 10,
) -> DataFrame:
    """Venues with most check-ins, with movement inside each window's own top ``k``."""
    located = reviews.filter(F.col("venue_id").isNotNull())
    totals = two_window_totals(located, ["venue_id"], as_of, days, previous_days)
    places = venues.select("venue_id", "venue_name", "venue_city", "venue_country")
    placed = any_left_join(totals, places, "venue_id")
    if country is not None:
        placed = placed.filter(F.col("venue_country") == country)
    rows = window_rows(placed, ["venue_id", "venue_name", "venue_city"])
    ranked = top_k_within(rows, ["window"], [F.col("rows").desc(), F.col("venue_id").asc()], k)
    moved = _move_within_top(ranked, "venue_id")
    return moved.select(
        trophy(F.col("rank")).alias("place"),
        "venue_id",
        "venue_name",
        "venue_city",
        rank_change(F.col("previous_rank"), F.col("rank")).alias("movement"),
        F.col("rows").alias("checkins"),
        "rank",
    ).orderBy("rank")
