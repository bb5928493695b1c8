"""Explicit schemas of files, records and stored tables, as DDL."""

from __future__ import annotations

# Result files.
SCATTER_RESULT = (
    "brewery_id bigint, brewery_pure_average double, rating_count bigint, brewery_name string, "
    "beer_count bigint, age_on_service double"
)
CITY_BOARD = (
    "`НАЗВАНИЕ` string, `ГОРОД` string, `РЕЙТИНГ` double, `ИЗМЕНЕНИЕ` string, `ЧЕКИНОВ` bigint"
)
TOP_BREWERIES = (
    "`Место` string, `Название пивоварни` string, `Рейтинг` double, `Изменение` string, `Чекинов` bigint"
)
TOP_VENUES = (
    "`Место` string, `Название` string, `Город` string, `Изменение` string, `Чекинов` bigint"
)
BEER_BOARD = (
    "`СОРТ ПИВА` string, `ПИВОВАРНЯ` string, `РЕЙТИНГ` double, `ИЗМЕНЕНИЕ` string, `ЧЕКИНОВ` bigint"
)

# Lookup files.
FEED_KEYWORDS = ("`Тип` string, `Уровень` string, `Направление` string, `Ключевое слово` string")
POSTING_KEYWORDS = ("`Язык` string, `Уровень` string, `Направление` string, `Ключевое слово` string")
PRICE_INDEX = ("_row int, country string, `index` double, cost double")
CONTINENTS = (
    "Continent_Name string, Continent_Code string, Country_Name string, Two_Letter_Country_Code string, "
    "Three_Letter_Country_Code string, Country_Number int"
)
PRICE_QUOTES = ("name string, local_price double, dollar_ex double, iso_a3 string, date date")
CATALOGUE = ("vine string, liter string, cost string")
CATALOGUE_NUMBERED = ("id bigint, vine string, master string, liter string, cost string")
ACTIVITY_RINGS = ("Description string, `Order` int, Response int, Goal int")


def yearly(first: int, last: int) -> str:
    """A wide table: country name and one number per year."""
    return ", ".join(["`Country Name` string", *[f"`{year}` double" for year in range(first, last + 1)]])


# Warehouse tables.
REVIEWS = (
    "beer_id bigint, brewery_id bigint, venue_id bigint, rating_score double, created_at timestamp"
)
VENUES = (
    "venue_id bigint, venue_city string, venue_country string, region_id string, region_name string"
)
BEERS = ("beer_id bigint, beer_name string, beer_style string")
BREWERY_INFO = ("brewery_id bigint, stats_age_on_service int")
BREWERIES = ("brewery_id bigint, brewery_name string, beer_count int")

# One vacancy of the feed.
FEED_RECORD = (
    "id string, name string, premium boolean, has_test boolean, response_url string, "
    "address struct<city: string, street: string, building: string, description: string, lat: double, "
    "lng: double, raw: string, metro_stations: array<struct<station_id: string, station_name: string, "
    "line_id: string, line_name: string, lat: double, lng: double>>>, "
    "alternate_url string, apply_alternate_url string, department struct<id: string, name: string>, "
    "salary struct<`from`: bigint, `to`: bigint, currency: string, gross: boolean>, "
    "insider_interview struct<id: string, url: string>, area struct<id: string, name: string, url: string>, "
    "url string, published_at string, "
    "employer struct<id: string, name: string, url: string, alternate_url: string, logo_urls: map<string, string>>, "
    "response_letter_required boolean, type struct<id: string, name: string>, archived boolean, "
    "schedule struct<id: string>"
)

# The stored postings, 23 columns.
POSTINGS = (
    "row_idx bigint, query_string string, country string, title string, company string, city string, "
    "job_added date, easy_apply int, company_rating double, remote int, job_id string, job_link string, "
    "sheet string, skills string, added_date date, month_salary_from_USD double, month_salary_to_USD double, "
    "year_salary_from_USD double, year_salary_to_USD double, month_salary_from_bigmac double, "
    "month_salary_to_bigmac double, year_salary_from_bigmac double, year_salary_to_bigmac double"
)
POSTING_COLUMNS = [column.split()[0] for column in POSTINGS.split(", ")]
