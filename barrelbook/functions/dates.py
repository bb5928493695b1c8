"""Wall-clock timestamps, relative dates, quarter sheets, result counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.periods import as_day

# Texts older than the service counts are dated 32 days back.
OLDER_MARKS = ("+", "более")
OLDER_DAYS = 32


def wall_clock(iso: Column) -> Column:
    """``2021-01-18T10:00:00+0300`` as the local time written in it; the offset is dropped."""
    return F.substring(iso, 1, 19).try_cast("timestamp_ntz")


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def quarter_sheet(day: Column) -> Column:
    """``IND-Q12021`` for a day in the first quarter of 2021."""
    return F.concat(F.lit("IND-Q"), F.quarter(day).cast("string"), F.year(day).cast("string"))


def relative_date(text: Column, as_of: str | date | Column) -> Column:
    """``5 days ago`` as a date; ``30+ days ago`` is 32 days back; NULL without a number."""
    day = as_of if isinstance(as_of, Column) else as_day(as_of)
    lowered = F.lower(text)
    older = F.contains(lowered, F.lit(OLDER_MARKS[0])) | F.contains(lowered, F.lit(OLDER_MARKS[1]))
    number = F.regexp_extract(lowered, r"(?:^|\s)(\d+)(?=\s|$)", 1).try_cast("int")
    return F.when(older, F.date_sub(day, OLDER_DAYS)).otherwise(F.date_sub(day, number))


def result_count(text: Column, country_code: Column) -> Column:
    """The number of results in a caption such as ``Page 1 of 1,234 jobs``. Where the
    number stands depends on the country; captions that do not fit give NULL."""
    tokens = F.split(F.btrim(F.regexp_replace(text, r"\s+", " ")), " ")

    def token(position: int) -> Column:
        return F.try_element_at(tokens, F.lit(position))

    number = (
        F.when(country_code == "gr", token(-3))
        .when(country_code == "kr", F.regexp_replace(token(-1), r"\D", ""))
        .when(country_code == "ro", token(4))
        .when(country_code == "vn", F.split_part(token(2), F.lit("/"), F.lit(-1)))
        .otherwise(token(-2))
    )
    return F.translate(number, ",.", "").try_cast("bigint")
