"""The periodic jobs. When they run is up to the caller."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ..operators.partials import read_days, store_days, trailing_totals_of_days, two_window_totals_of_days
from ..operators.periods import trailing_totals, two_window_totals
from ..session import checkpointed
from ..sources.published import publish
from ..sources.readers import read_table
from ..sources.sinks import export_table, overwrite_by
from . import leaderboards, scatter
from .vacancies import export_view

#: Grains of the stored days: the boards need venue and brewery, the beer boards beer and brewery.
PLACES, BEERS = "venue_id bigint, brewery_id bigint", "beer_id bigint, brewery_id bigint"


def _keys(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def refresh(
    reviews: DataFrame,
    venues: DataFrame,
    breweries: DataFrame,
    brewery_info: DataFrame,
    beers: DataFrame,
    as_of: str | date,
    out: str,
    country: str = leaderboards.HOME_COUNTRY,
    days: int = 30,
    board_cities: dict[str, str] | None = leaderboards.BOARD_CITIES,
    scatter_days: int = 100,
    scatter_top: int = 200,
    scatter_min_count: int = 150,
) -> dict[str, str]:
    """Rebuild every result from the check-ins and publish them at once below ``out``; returns
    the paths by name."""
    grains = {"places": reviews, "beers": reviews}
    sums = {"totals_of": two_window_totals}, {"totals_of": trailing_totals}
    return _publish_boards(
        grains, sums, venues, breweries, brewery_info, beers, as_of, out, country, days, board_cities,
        scatter_days, scatter_top, scatter_min_count,
    )


def store_checkin_days(reviews: DataFrame, out: str, first: str | date, last: str | date | None = None) -> None:
    """Add up the check-ins of some days, for ``refresh_from_days``. Only those days are read."""
    for name, ddl in (("places", PLACES), ("beers", BEERS)):
        store_days(reviews, f"{out}/days/{name}", _keys(ddl), first, last)


def refresh_from_days(
    spark: SparkSession,
    venues: DataFrame,
    breweries: DataFrame,
    brewery_info: DataFrame,
    beers: DataFrame,
    as_of: str | date,
    out: str,
    country: str = leaderboards.HOME_COUNTRY,
    days: int = 30,
    board_cities: dict[str, str] | None = leaderboards.BOARD_CITIES,
    scatter_days: int = 100,
    scatter_top: int = 200,
    scatter_min_count: int = 150,
) -> dict[str, str]:
    """The same results from the days that ``store_checkin_days`` has stored: the job of the next
    day stores that day and reads no other check-ins."""
    grains = {name: read_days(spark, f"{out}/days/{name}", ddl) for name, ddl in (("places", PLACES), ("beers", BEERS))}
    sums = {"totals_of": two_window_totals_of_days}, {"totals_of": trailing_totals_of_days}
    return _publish_boards(
        grains, sums, venues, breweries, brewery_info, beers, as_of, out, country, days, board_cities,
        scatter_days, scatter_top, scatter_min_count,
    )


def _publish_boards(
    grains, sums, venues, breweries, brewery_info, beers, as_of, out, country, days, board_cities,
    scatter_days, scatter_top, scatter_min_count,
) -> dict[str, str]:
    """All cities are one job, stored in one folder per city. Both beer boards share one pass."""
    two, one = sums
    windows = {"as_of": as_of, "days": days, "previous_days": days}
    cities = leaderboards.city_leaderboard(
        grains["places"], venues, breweries, country=country, board_cities=board_cities, **windows, **two
    )
    totals = checkpointed(leaderboards.beer_totals(grains["beers"], **windows, **two))
    results = {
        "cities": lambda path: overwrite_by(cities, path, ["board_city"]),
        "top_best_beers": leaderboards.best_beers(totals, beers, breweries),
        "top_worst_beers": leaderboards.worst_beers(totals, beers, breweries),
        "ratio_scatter_plot": scatter.brewery_scatter(
            grains["beers"], breweries, brewery_info, as_of, scatter_days, scatter_top, scatter_min_count, **one
        ),
    }
    return publish(venues.sparkSession, out, results, {"as_of": as_of})


def export_vacancies(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Write the stored vacancies as CSV, missing text as empty."""
    return export_table(spark, table, path, lambda session, name: export_view(read_table(session, name)))
