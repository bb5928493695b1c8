"""Vacancy feeds: nested records to flat rows, and postings with normalised salaries."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, rules, salary, text
from ..functions.literals import literal_map
from ..functions.numbers import flag, present, ratio
from ..operators.joins import dict_lookup, new_rows
from ..operators.periods import as_day
from ..operators.ranking import number_rows_after
from ..sources.html import ITSELF, extract_items
from ..sources.schemas import POSTING_COLUMNS

FEED_KEYS = ["vacancy_id", "query_string"]
POSTING_KEYS = ["job_id", "query_string"]

# Limits of the feed filter.
MIN_SALARY = 15000
MIN_SALARY_CURRENCY = "RUR"
REJECTED_SCHEDULE = "flyInFlyOut"

# Country codes of the posting feed and their names.
COUNTRIES = {
    "br": "Brazil", "ca": "Canada", "cl": "Chile", "cn": "China", "co": "Colombia",
    "cz": "Czech Republic", "dk": "Denmark", "fi": "Finland", "fr": "France", "de": "Germany",
    "gr": "Greece", "hk": "Hong Kong", "hu": "Hungary", "in": "India", "id": "Indonesia",
    "ie": "Ireland", "il": "Israel", "it": "Italy", "jp": "Japan", "kr": "Korea", "kw": "Kuwait",
    "lu": "Luxembourg", "my": "Malaysia", "mx": "Mexico", "nl": "Netherlands", "nz": "New Zealand",
    "no": "Norway", "om": "Oman", "pk": "Pakistan", "pe": "Peru", "ph": "Philippines",
    "pl": "Poland", "pt": "Portugal", "qt": "Qatar", "ro": "Romania", "ru": "Russia",
    "sa": "Saudi Arabia", "sg": "Singapore", "za": "South Africa", "es": "Spain", "se": "Sweden",
    "ch": "Switzerland", "tw": "Taiwan", "th": "Thailand", "tr": "Turkey",
    "ae": "United Arab Emirates", "gb": "United Kingdom", "us": "United States", "ve": "Venezuela",
    "vn": "Vietnam",
}
KEYWORD_LANGUAGES = {"ru": "ru"}  # every other country searches in English
DEFAULT_LANGUAGE = "en"

# Markup of a result page.
CARD = ("div", "jobsearch-SerpJobCard")
CARD_FIELDS = {
    "element_id": (ITSELF, None, "id"),
    "title": ("a", "jobtitle", None),
    "href": ("a", "jobtitle", "href"),
    "company": ("span", "company", None),
    "city": (None, "location", None),
    "summary": ("div", "summary", None),
    "date_text": ("span", "date", None),
    "salary_text": ("span", "salaryText", None),
    "easy_label": ("span", "iaLabel", None),
    "rating_text": ("span", "ratingsContent", None),
    "remote_label": ("span", "remote", None),
}
BAD_QUERY = "bad_query"
PAGE_FIELDS = {"bad_query": (None, BAD_QUERY, None), "caption": ("div", "#searchCountPages", None)}


def _lookup(code: Column, names: Mapping[str, str], default: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(names), code), default)


def country_name(code: Column) -> Column:
    """Country of a feed code; NULL for an unknown one."""
    return _lookup(code, COUNTRIES, F.lit(None).cast("string"))


def keywords_by_country(keywords: DataFrame, countries: DataFrame) -> DataFrame:
    """Search terms per country, by the country's language. ``keywords``: language, query;
    ``countries``: country_code."""
    language = _lookup(F.col("country_code"), KEYWORD_LANGUAGES, F.lit(DEFAULT_LANGUAGE))
    return countries.withColumn("language", language).join(keywords, "language")


# Nested feed ----------------------------------------------------------------------


def feed_accepts(record: Column) -> Column:
    """Whether a feed record is kept: identified, wanted name, not underpaid, not archived,
    no fly-in-fly-out schedule. Other missing parts never reject."""
    pay = record["salary"]
    reasons = [
        rules.excluded_name(text.strip_quotes(record["name"])),
        (pay["currency"] == MIN_SALARY_CURRENCY) & (pay["from"] < MIN_SALARY),
        record["archived"],
        record["schedule"]["id"] == REJECTED_SCHEDULE,
    ]
    rejected = F.coalesce(reasons[0], F.lit(False))
    for reason in reasons[1:]:
        rejected = rejected | F.coalesce(reason, F.lit(False))
    return record["id"].isNotNull() & ~rejected


def accepted_records(records: DataFrame) -> DataFrame:
    """The kept records. A plain filter on parts of a parsed record would be pushed below
    the parsing and parse once per part; this way every record is parsed once."""
    kept = F.filter(F.array("record"), feed_accepts)
    return records.withColumn("record", F.explode(kept))


def flatten_feed(records: DataFrame) -> DataFrame:
    """The 45 columns of a stored vacancy from added_at, query_string, query_type, level,
    direction and the nested ``record``. A missing parent leaves its columns NULL."""
    field = lambda path: F.col(f"record.{path}")
    logo = lambda size: field("employer.logo_urls").getItem(size)
    return records.select(
        "added_at",
        "query_string",
        "query_type",
        "level",
        "direction",
        field("id").alias("vacancy_id"),
        flag(field("premium")).alias("is_premium"),
        flag(field("has_test")).alias("has_test"),
        field("response_url").alias("response_url"),
        field("address.city").alias("address_city"),
        field("address.street").alias("address_street"),
        field("address.building").alias("address_building"),
        field("address.description").alias("address_description"),
        field("address.lat").alias("address_lat"),
        field("address.lng").alias("address_lng"),
        field("address.raw").alias("address_raw"),
        F.to_json(field("address.metro_stations")).alias("address_metro_stations"),
        field("alternate_url").alias("alternate_url"),
        field("apply_alternate_url").alias("apply_alternate_url"),
        field("department.id").alias("department_id"),
        field("department.name").alias("department_name"),
        field("salary.from").alias("salary_from"),
        field("salary.to").alias("salary_to"),
        field("salary.currency").alias("salary_currency"),
        flag(field("salary.gross")).alias("salary_gross"),
        text.strip_quotes(field("name")).alias("name"),
        field("insider_interview.id").alias("insider_interview_id"),
        field("insider_interview.url").alias("insider_interview_url"),
        field("area.url").alias("area_url"),
        field("area.id").alias("area_id"),
        field("area.name").alias("area_name"),
        field("url").alias("url"),
        dates.wall_clock(field("published_at")).alias("published_at"),
        field("employer.url").alias("employer_url"),
        field("employer.alternate_url").alias("employer_alternate_url"),
        logo("90").alias("employer_logo_urls_90"),
        logo("240").alias("employer_logo_urls_240"),
        logo("original").alias("employer_logo_urls_original"),
        text.strip_quotes(field("employer.name")).alias("employer_name"),
        field("employer.id").alias("employer_id"),
        flag(field("response_letter_required")).alias("response_letter_required"),
        field("type.id").alias("type_id"),
        field("type.name").alias("type_name"),
        flag(field("archived")).alias("is_archived"),
        field("schedule.id").alias("schedule"),
    )


def vacancy_feed(records: DataFrame, stored: DataFrame) -> DataFrame:
    """New, accepted vacancies of a batch of records, each (vacancy, query) once."""
    accepted = flatten_feed(accepted_records(records))
    return new_rows(accepted, stored, FEED_KEYS, ["published_at"])


def export_view(df: DataFrame) -> DataFrame:
    """Missing text as the empty string, for text exports."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.fillna("", subset=names)


# Postings -------------------------------------------------------------------------


def result_cards(pages: DataFrame, keep: list[str]) -> DataFrame:
    """One row per result card. Pages that report a bad query have no cards."""
    return extract_items(pages, "html", CARD_FIELDS, keep, CARD, unless=BAD_QUERY)


def reports_bad_query(html: Column) -> Column:
    """Whether an element of a result page has the class of the bad-query notice."""
    return html.rlike(r"""(?is)<[a-z][^>]*\sclass\s*=\s*(?:"(?:[^"]*\s)?bad_query[\s"]|'(?:[^']*\s)?bad_query[\s']|bad_query[\s>])""")


def page_summaries(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Per result page whether the query was bad, and how many results it announces.
    ``pages`` has country_code."""
    kept = [*keep, *(["country_code"] if "country_code" not in keep else [])]
    found = extract_items(pages, "html", PAGE_FIELDS, kept)
    return found.select(
        *keep,
        present(F.col("bad_query")).alias("bad_query"),
        dates.result_count(F.col("caption"), F.col("country_code")).alias("results"),
    )


def parse_salaries(postings: DataFrame, salary_text: str = "salary_text") -> DataFrame:
    """Attach salary_period, salary_currency, salary_from and salary_to as stated in the
    text. Steps are columns of their own, so that none is worked out twice."""
    split = postings.withColumn("_split", salary.split_period(F.col(salary_text)))
    stated = split.withColumns(
        {
            "salary_period": F.col("_split.period"),
            "salary_currency": salary.currency_of(F.col("_split.text")),
            "_amounts": salary.clean_amounts(salary.without_currency(F.col("_split.text"))),
        }
    )
    bounds = stated.withColumns(
        {"_low": salary.range_bound(F.col("_amounts"), 1), "_high": salary.range_bound(F.col("_amounts"), -1)}
    )
    period = F.col("salary_period")
    return bounds.withColumns(
        {
            "salary_from": salary.amount(F.col("_low"), period),
            "salary_to": salary.amount(F.col("_high"), period),
        }
    ).drop("_split", "_amounts", "_low", "_high")


def normalise_salaries(
    postings: DataFrame,
    rates: DataFrame,
    price_index: DataFrame,
    as_of: str | date,
    salary_text: str = "salary_text",
    country: str = "country",
) -> DataFrame:
    """Attach monthly and yearly bounds in dollars and in price-index units, and a status.

    ``rates``: currency, rate_date, usd (dollars per unit); only ``as_of`` is used.
    ``price_index``: country, cost. ``salary_status`` is ``ok``, ``no_salary``,
    ``no_period``, ``bad_amount``, ``no_rate`` or ``no_index``; amounts that cannot be
    worked out are NULL.
    """
    # One row per currency that a text can name: never more than the list of signs.
    named = sorted({code for _, code in salary.CURRENCY_SIGNS})
    today = rates.filter((F.col("rate_date") == as_day(as_of)) & F.col("currency").isin(named))
    day_rates = today.groupBy(F.col("currency").alias("salary_currency")).agg(F.min("usd").alias("_usd"))
    costs = price_index.groupBy(F.col("country").alias(country)).agg(F.min("cost").alias("_cost"))
    parsed = parse_salaries(postings, salary_text)
    priced = dict_lookup(dict_lookup(parsed, F.broadcast(day_rates), "salary_currency"), costs, country)
    rate = F.when(F.col("salary_currency") == "USD", F.lit(1.0)).otherwise(
        F.coalesce(F.col("_usd"), salary.fallback_rate(F.col("salary_currency")))
    )
    factor = salary.month_factor(F.col("salary_period"))
    status = (
        F.when(F.col(salary_text).isNull(), "no_salary")
        .when(F.col("salary_period") == "", "no_period")
        .when(F.col("salary_from").isNull() & F.col("salary_to").isNull(), "bad_amount")
        .when(rate.isNull(), "no_rate")
        .when(F.col("_cost").isNull(), "no_index")
        .otherwise("ok")
    )
    monthly = {f"month_salary_{side}_USD": F.col(f"salary_{side}") * factor * rate for side in ("from", "to")}
    valued = priced.withColumns({**monthly, "salary_status": status})
    derived = {}
    for side in ("from", "to"):
        dollars = F.col(f"month_salary_{side}_USD")
        units = ratio(dollars, F.col("_cost"))
        derived[f"year_salary_{side}_USD"] = dollars * 12
        derived[f"month_salary_{side}_bigmac"] = units
        derived[f"year_salary_{side}_bigmac"] = units * 12
    helpers = ["salary_period", "salary_currency", "salary_from", "salary_to", "_usd", "_cost"]
    return valued.withColumns(derived).drop(*helpers)


def accepted_cards(cards: DataFrame) -> DataFrame:
    """Cards whose title matches a rule of the query they were found by, with their job id."""
    title = text.strip_newlines(F.col("title"))
    return cards.filter(rules.title_matches(title, F.col("query_string"))).withColumns(
        {"title": title, "job_id": text.id_after_underscore(F.col("element_id"))}
    )


def posting_rows(
    accepted: DataFrame, rates: DataFrame, price_index: DataFrame, as_of: str | date
) -> DataFrame:
    """Stored form of accepted cards: skills, dates, links and salaries. Needs query_string,
    country_code, job_id and the card fields; row_idx is passed on if present."""
    described = accepted.withColumn("country", country_name(F.col("country_code")))
    priced = normalise_salaries(described, rates, price_index, as_of)
    day = as_day(as_of)
    return priced.select(
        *[c for c in ("row_idx",) if c in accepted.columns],
        "query_string",
        "country",
        "title",
        text.strip_newlines(F.col("company")).alias("company"),
        "city",
        F.coalesce(dates.relative_date(F.col("date_text"), as_of), day).alias("job_added"),
        present(F.col("easy_label")).alias("easy_apply"),
        F.col("rating_text").try_cast("double").alias("company_rating"),
        present(F.col("remote_label")).alias("remote"),
        "job_id",
        text.posting_link(F.col("country_code"), F.col("href")).alias("job_link"),
        dates.quarter_sheet(day).alias("sheet"),
        text.skill_tags(F.col("summary")).alias("skills"),
        day.alias("added_date"),
        *[
            f"{span}_salary_{side}_{unit}"
            for unit in ("USD", "bigmac")
            for span in ("month", "year")
            for side in ("from", "to")
        ],
    )


def vacancy_salaries(
    cards: DataFrame, stored: DataFrame, rates: DataFrame, price_index: DataFrame, as_of: str | date
) -> DataFrame:
    """New postings of a batch of cards, with row ids that follow the stored ones.

    A rejected card is never stored and so does not hide a later one with its key: titles
    are judged first. Ids are given before salaries are worked out, so that the numbering
    moves short rows and nothing is parsed twice.
    """
    fresh = new_rows(accepted_cards(cards), stored, POSTING_KEYS, ["position"])
    numbered = number_rows_after(stored, fresh, [F.col("query_string").asc(), F.col("job_id").asc()])
    return posting_rows(numbered, rates, price_index, as_of).select(*POSTING_COLUMNS)
