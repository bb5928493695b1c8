"""Inputs derived from table columns, as SQL text that Spark and DuckDB both accept.

The given tables hold no vacancies, salary texts or captions, so these are spelled out from
order, customer and nation columns. Only inputs are derived here; what the jobs make of
them is computed separately on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence


def pick(index: str, values: Sequence[str]) -> str:
    """The value at ``index`` modulo the number of values (SQL expressions)."""
    branches = " ".join(f"WHEN {i} THEN {value}" for i, value in enumerate(values))
    return f"CASE ({index}) % {len(values)} {branches} END"


def texts(*values: str | None) -> list[str]:
    return ["CAST(NULL AS STRING)" if v is None else "'" + v.replace("'", "''") + "'" for v in values]


def text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def thousands(expression: str) -> str:
    """``12345`` as ``12,345``."""
    head = text(f"CAST(floor({expression} / 1000) AS BIGINT)")
    return f"{head} || ',' || lpad({text(f'({expression}) % 1000')}, 3, '0')"


AMOUNT = "CAST(floor(o_totalprice) AS BIGINT)"

# Country code by nation key; four of them have captions of their own.
CODES = (
    "br ca cl cn co cz dk fi fr de gr hk hu in id ie il it jp kr kw lu my ro vn".split()
)
COUNTRY_CODE = pick("n_nationkey", texts(*CODES))

QUERIES = (
    "Data analyst",
    '"BI Analyst"',
    '"Аналитик данных" OR "Data analyst"',
    "Head of analytics OR Head of BI",
    "Junior Data Analyst",
    "Query without rules",
)
TITLES = (
    "Senior Data Analyst",
    "junior data analyst",
    'Lead "BI" Analyst (SQL)',
    "старший АНАЛИТИК больших данных",
    "Head of BI",
    "HEAD of the Business Intelligence team",
    "Metadata analyst",
    "Data analystics",
)


def query(key: str) -> str:
    return pick(key, texts(*QUERIES))


def title(key: str) -> str:
    return pick(f"CAST(floor(({key}) / 6) AS BIGINT)", texts(*TITLES))


def salary(key: str, amount: str = AMOUNT) -> str:
    """One salary text per case: period, sign, separators, ranges, and what goes wrong."""
    a, b = text(amount), text(f"{amount} + 500")
    grouped = f"{text(f'CAST(floor({amount} / 1000) AS BIGINT)')} || '.' || lpad({text(f'{amount} % 1000')}, 3, '0')"
    return pick(
        key,
        [
            f"'$' || {a} || ' a month'",
            f"'R$ ' || {a} || ' - R$ ' || {b} || ' por mês'",
            f"'€' || {grouped} || ' pro Jahr'",
            f"'From $' || {thousands(amount)} || ' a year'",
            f"'Up to £' || {a} || ' a week'",
            f"{a} || ' zł - ' || {b} || ' zł za godzinę'",
            f"'月薪 ' || {text(f'{amount} % 50 + 1')} || '万元'",
            f"'Rs' || {a} || ' a day'",
            "CAST(NULL AS STRING)",
            f"{a} || ',50 kr per timme'",
            f"'$' || {a}",
            f"{a} || ' XYZ a month'",
            "''",
            f"'$' || {text(f'{amount} % 90 + 10')} || '.50 an hour'",
            f"{text(f'{amount} % 9 + 1')} || '万円~' || {text(f'{amount} % 9 + 3')} || '万円 年'",
            "'abc $ a month'",
        ],
    )


DATE_TEXTS = ("30+ days ago", "5 days ago", "Just posted", "Более 30 дней назад", "14 дней назад", None)


def date_text(key: str) -> str:
    return pick(key, texts(*DATE_TEXTS))


SUMMARIES = (
    "Python, SQL and Power BI",
    "You know R or r and excel.",
    "No tools at all",
    "ClickHouse / NoSQL, Apache Spark & Airflow",
)


def summary(key: str) -> str:
    return pick(key, texts(*SUMMARIES))


def caption(code: str, amount: str = AMOUNT) -> str:
    """Result count as each country writes it."""
    return (
        f"CASE {code} WHEN 'gr' THEN 'Σελίδα 1 από ' || {thousands(amount)} || ' θέσεις εργασίας' "
        f"WHEN 'kr' THEN '검색결과 ' || {thousands(amount)} || '건' "
        f"WHEN 'ro' THEN 'Pagina 1 din ' || {text(amount)} || ' anunțuri' "
        f"WHEN 'vn' THEN 'Trang 1/' || {text(amount)} || ' việc' "
        f"ELSE ' Page 1 of  ' || {thousands(amount)} || ' jobs' END"
    )


def vacancy_name(key: str) -> str:
    return pick(
        key,
        [
            "'курьер ' || c_mktsegment",
            "'Data \"Analyst\" ' || c_mktsegment",
            "'Оператор ' || c_mktsegment",
            "'маркетолог'",
            "'маркетолог ' || c_mktsegment",
            "'Lead''s маркетолог'",
        ],
    )


# Dollars per unit on the pricing day, and decoys of another day.
PRICING_DAY = "2021-01-18"
RATES = {"EUR": 1.2064, "GBP": 1.3583, "BRL": 0.189, "PLN": 0.266, "JPY": 0.0096, "SEK": 0.1191, "CNY": 0.1541}
OTHER_DAY = "2021-01-15"

# Latin letters of names written in Cyrillic, to be transliterated back.
LATIN = "abvgdezjklmnoprstufhiABVGDEZKLMNOPRSTUFH"
CYRILLIC = "абвгдезйклмнопрстуфхиАБВГДЕЗКЛМНОПРСТУФХ"
