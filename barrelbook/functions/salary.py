"""Salary text to monthly amounts in one currency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import literal_rows

# Phrases that name the pay period, in the order they are tried.
PERIODS = {
    "a year": "year",
    "per jaar": "year",
    "por ano": "year",
    "par an": "year",
    "all'anno": "year",
    "pro Jahr": "year",
    "một năm": "year",
    "al año": "year",
    "年": "year",
    "pe an": "year",
    "rocznie": "year",
    "a month": "month",
    "al mese": "month",
    "al mes": "month",
    "por mês": "month",
    "per maand": "month",
    "měsíčně": "month",
    "par mois": "month",
    "pro Monat": "month",
    "per bulan": "month",
    "ต่อเดือน": "month",
    "в месяц": "month",
    "một tháng": "month",
    "شهر": "month",
    "月薪": "month",
    "miesięcznie": "month",
    "a day": "day",
    "per dag": "day",
    "par jour": "day",
    "an hour": "hour",
    "za hodinu": "hour",
    "par heure": "hour",
    "pro Stunde": "hour",
    "per timme": "hour",
    "pe oră": "hour",
    "một giờ": "hour",
    "por hora": "hour",
    "za godzinę": "hour",
    "per uur": "hour",
    "a week": "week",
    "per week": "week",
    "par semaine": "week",
    "บาทต่อสัปดาห์": "week",
    "por semana": "week",
}

# Currency signs, in the order they are tried.
CURRENCY_SIGNS = (
    ("R$", "BRL"), ("$", "USD"), ("€", "EUR"), ("Kč", "CZK"), ("₹", "INR"), ("Rp.", "IDR"),
    ("원", "KRW"), ("руб", "RUB"), ("₽", "RUB"), ("円", "JPY"), ("VNĐ", "VND"), ("บาท", "THB"),
    ("kr", "SEK"), ("元", "CNY"), ("RON", "RON"), ("zł", "PLN"), ("Rs", "INR"), ("S/.", "PEN"),
    ("PHP", "PHP"), ("R", "ZAR"), ("CHF", "CHF"), ("AED", "AED"), ("£", "GBP"),
)

# Working units per month.
MONTH_FACTORS = {"hour": 160.0, "day": 20.0, "week": 4.0, "month": 1.0, "year": 1 / 12}

# Rates used where the rate table has none.
FALLBACK_USD_RATES = {"VND": 4e-5, "PEN": 0.27664, "AED": 0.272300}

# Words and signs that carry no amount.
NOISE = ("収", "월급", "Up to", "From", "{", "}", "\n")
TEN_THOUSAND = ("万", "0000")


def split_period(text: Column, periods: Mapping[str, str] = PERIODS) -> Column:
    """Struct of the text without period phrases and the period, the last match winning.

    Each phrase is looked for in what the phrases before it left over.
    """
    phrases = literal_rows(list(periods.items()), ["phrase", "period"])
    start = F.struct(text.alias("text"), F.lit("").alias("period"))

    def step(seen: Column, entry: Column) -> Column:
        shorter = F.replace(seen["text"], entry["phrase"], F.lit(""))
        found = F.struct(shorter.alias("text"), entry["period"].alias("period"))
        return F.when(F.contains(seen["text"], entry["phrase"]), found).otherwise(seen)

    # Most texts name no period; one precompiled pattern spares them the loop over the phrases.
    named = text.rlike("|".join(f"\\Q{phrase}\\E" for phrase in periods))
    return F.when(named, F.aggregate(phrases, start, step)).otherwise(start)


def currency_of(text: Column, signs: Sequence[tuple[str, str]] = CURRENCY_SIGNS) -> Column:
    """Currency code of the first sign that occurs; the empty string if none does."""
    return _first_sign(text, signs, 1)


def without_currency(text: Column, signs: Sequence[tuple[str, str]] = CURRENCY_SIGNS) -> Column:
    """The text without its currency sign."""
    return F.replace(text, _first_sign(text, signs, 0), F.lit(""))


def _first_sign(text: Column, signs: Sequence[tuple[str, str]], part: int) -> Column:
    chain = F.when(F.contains(text, F.lit(signs[0][0])), F.lit(signs[0][part]))
    for entry in signs[1:]:
        chain = chain.when(F.contains(text, F.lit(entry[0])), F.lit(entry[part]))
    return chain.otherwise(F.lit(""))


def clean_amounts(text: Column) -> Column:
    """The text reduced to its amounts and their separator."""
    text = F.replace(text, F.lit(TEN_THOUSAND[0]), F.lit(TEN_THOUSAND[1]))
    for word in NOISE:
        text = F.replace(text, F.lit(word), F.lit(""))
    return text


def range_bound(text: Column, side: int) -> Column:
    """Lower (``side=1``) or upper (``side=-1``) bound of ``a-b`` or ``a~b``; a single
    amount is both."""
    return F.when(F.contains(text, F.lit("-")), F.split_part(text, F.lit("-"), F.lit(side))).otherwise(
        F.split_part(text, F.lit("~"), F.lit(side))
    )


def amount(text: Column, period: Column) -> Column:
    """Number text to double. Commas, blanks and apostrophes separate thousands; a dot
    does too, unless it is the only one and the pay is hourly. No number gives NULL."""
    dots = F.length(text) - F.length(F.translate(text, ".", ""))
    decimal_dot = (dots == 1) & (period == "hour")
    digits = F.translate(F.when(decimal_dot, text).otherwise(F.translate(text, ".", "")), ", ’", "")
    digits = F.regexp_replace(digits, r"(?U)^\s+|\s+$", "")
    return F.when(digits.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), digits.try_cast("double"))


def month_factor(period: Column, factors: Mapping[str, float] = MONTH_FACTORS) -> Column:
    """How many of the period make a month; NULL for an unknown period."""
    chain = F.lit(None).cast("double")
    for unit, factor in reversed(list(factors.items())):
        chain = F.when(period == unit, F.lit(float(factor))).otherwise(chain)
    return chain


def fallback_rate(currency: Column, rates: Mapping[str, float] = FALLBACK_USD_RATES) -> Column:
    chain = F.lit(None).cast("double")
    for code, rate in reversed(list(rates.items())):
        chain = F.when(currency == code, F.lit(float(rate))).otherwise(chain)
    return chain
