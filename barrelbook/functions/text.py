"""Text cleaning, labels, keyword tags, links, transliteration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Skill keywords, in output order. `' r '` needs its blanks.
SKILLS = (
    "python", "tableau", "etl", "power bi", "d3.js", "qlik", "qlikview", "qliksense",
    "redash", "metabase", "numpy", "pandas", "congos", "superset", "matplotlib", "plotly",
    "airflow", "spark", "luigi", "machine learning", "amplitude", "sql", "nosql", "clickhouse",
    "sas", "hadoop", "pytorch", "tensorflow", "bash", "scala", "git", "aws", "docker",
    "linux", "kafka", "nifi", "ozzie", "ssas", "ssis", "redis", "olap", " r ", "bigquery", "api", "excel",
)

# Cyrillic letters written with one Latin character each ...
CYRILLIC = "абвгдезийклмнопрстуфхъыьёэАБВГДЕЗИЙКЛМНОПРСТУФХЪЫЬЁЭ"
LATIN = "abvgdezijklmnoprstufh'y'eeABVGDEZIJKLMNOPRSTUFH'Y'EE"
# ... and with several.
CYRILLIC_DIGRAPHS = {
    "ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "ju", "я": "ja",
    "Ж": "Zh", "Ц": "Ts", "Ч": "Ch", "Ш": "Sh", "Щ": "Sch", "Ю": "Ju", "Я": "Ja",
}


# Fixed value: host of the postings, below one subdomain per country.
POSTING_HOST = "indeed.com"


def strip_quotes(text: Column) -> Column:
    """Without single and double quotes."""
    return F.translate(text, "'\"", "")


def strip_newlines(text: Column) -> Column:
    return F.translate(text, "\n", "")


def or_empty(text: Column) -> Column:
    """NULL as the empty string, for export views."""
    return F.coalesce(text.cast("string"), F.lit(""))


def skill_tags(text: Column, skills: Sequence[str] = SKILLS) -> Column:
    """The keywords found in ``text``, comma-joined in list order; NULL text stays NULL.

    The empty prefix carries the NULL. It stands outside any condition, so the lowered
    text is a common subexpression that is worked out once per row.
    """
    lowered = F.lower(text)
    hits = [F.when(F.contains(lowered, F.lit(skill)), F.lit(skill)) for skill in skills]
    return F.concat(F.left(text, F.lit(0)), F.concat_ws(",", *hits))


def transliterate(text: Column) -> Column:
    """Cyrillic to Latin letters; other characters stay."""
    for letter, latin in CYRILLIC_DIGRAPHS.items():
        text = F.replace(text, F.lit(letter), F.lit(latin))
    return F.translate(text, CYRILLIC, LATIN)


def id_after_underscore(element_id: Column) -> Column:
    """``p_123`` gives ``123``; no underscore gives the empty string."""
    return F.split_part(element_id, F.lit("_"), F.lit(2))


def posting_link(country_code: Column, href: Column) -> Column:
    """Absolute link of a posting; NULL without ``href``."""
    return F.concat(F.lit("https://"), country_code, F.lit(f".{POSTING_HOST}"), href)


def marker_label(name: Column, products: Column, ratings: Column, mean: Column) -> Column:
    """Hover text of a scatter marker."""
    return F.concat(
        F.lit("<b>"), name, F.lit("</b>,<br>сварили "), products.cast("string"),
        F.lit(" сортов пива<br>получили "), ratings.cast("string"),
        F.lit(" чекина<br>со средним рейтингом "), F.bround(mean, 2).cast("string"),
    )


def short_marker_label(name: Column, products: Column, caption: str) -> Column:
    """Hover text with the number of products only."""
    return F.concat(name, F.lit(f",<br>{caption}: "), products.cast("string"))


def median_label(median: Column) -> Column:
    """Text beside a median line."""
    return F.concat(F.lit("Медианное значение: "), F.bround(median, 2).cast("string"))
