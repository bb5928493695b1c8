"""Column functions, case by case."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from barrelbook.functions import dates, numbers, rules, salary, text


def evaluate(spark, column, values, ddl="value string"):
    """The column over one row per value, in order."""
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"_n int, {ddl}")
    return [r[0] for r in df.select(column.alias("x"), "_n").orderBy("_n").select("x").collect()]


def test_size_class(spark):
    counts = [0, 9, 10, 30, 31, 50, 51, None]
    assert evaluate(spark, numbers.size_class(F.col("value")), counts, "value int") == [7, 7, 9, 9, 11, 11, 13, 13]


def test_age_class(spark):
    years = [0.0, 3.99, 4.0, 6.0, 6.01, 7.99, 8.0, None, float("nan")]
    assert evaluate(spark, numbers.age_class(F.col("value")), years, "value double") == [0, 0, 1, 1, 2, 2, 3, 3, 3]


def test_or_zero(spark):
    assert evaluate(spark, numbers.or_zero(F.col("value")), [None, float("nan"), 2.5], "value double") == [0, 0, 2.5]


def test_round_even(spark):
    assert evaluate(spark, numbers.round_even(F.col("value")), [0.125, 0.375, 2.675], "value double") == [0.12, 0.38, 2.68]


def test_decimal_comma(spark):
    assert evaluate(spark, numbers.parse_decimal_comma(F.col("value")), ["3,7", "4", "–", None]) == [3.7, 4.0, None, None]
    assert evaluate(spark, numbers.format_decimal_comma(F.col("value")), [3.7, None], "value double") == ["3,7", None]


def test_text_cleaning(spark):
    assert evaluate(spark, text.strip_quotes(F.col("value")), ["a'b\"c", None]) == ["abc", None]
    assert evaluate(spark, text.strip_newlines(F.col("value")), ["a\nb\n"]) == ["ab"]
    assert evaluate(spark, text.or_empty(F.col("value")), [None, "x"]) == ["", "x"]
    assert evaluate(spark, text.id_after_underscore(F.col("value")), ["p_12", "p"]) == ["12", ""]


def test_skill_tags_keep_list_order(spark):
    found = evaluate(spark, text.skill_tags(F.col("value")), ["SQL and Python, r", "R, uses r too", "none", None])
    assert found == ["python,sql", " r ", "", None]


def test_transliterate(spark):
    words = ["Шато Щука", "объём Эля", "Wine 2015", "цапля жюри чай"]
    assert evaluate(spark, text.transliterate(F.col("value")), words) == [
        "Shato Schuka", "ob'em Elja", "Wine 2015", "tsaplja zhjuri chaj",
    ]


def test_wall_clock_drops_offset(spark):
    values = ["2021-01-18T10:05:00+0300", "not a time", None]
    assert evaluate(spark, dates.wall_clock(F.col("value")), values) == [datetime(2021, 1, 18, 10, 5), None, None]


@pytest.mark.parametrize(("month", "quarter"), [(m, (m + 2) // 3) for m in range(1, 13)])
def test_quarter_sheet(spark, month, quarter):
    assert evaluate(spark, dates.quarter_sheet(F.col("value")), [date(2021, month, 28)], "value date") == [f"IND-Q{quarter}2021"]


def test_relative_date(spark):
    values = ["30+ days ago", "более 30 дней", "5 days ago", "vor 14 Tagen", "Just posted", "12h", None]
    days = evaluate(spark, dates.relative_date(F.col("value"), "2021-02-10"), values)
    assert days == [date(2021, 1, 9), date(2021, 1, 9), date(2021, 2, 5), date(2021, 1, 27), None, None, None]


def test_result_count(spark):
    values = [
        ("Page 1 of 1,234 jobs", "us"), ("Σελίδα 1 από 12 θέσεις εργασίας", "gr"), ("검색결과 1,021건", "kr"),
        ("Pagina 1 din 7 anunțuri", "ro"), ("Trang 1/2.345 việc", "vn"), ("nothing", "us"), ("", "vn"),
    ]
    column = dates.result_count(F.col("caption"), F.col("code"))
    assert evaluate(spark, column, values, "caption string, code string") == [1234, 12, 1021, 7, 2345, None, None]


def test_excluded_names(spark):
    names = ["курьер", "курьерская служба", "старший курьер", "Курьер", "маркетолог", "маркетолог BI", "маркетолог по SEO"]
    assert evaluate(spark, rules.excluded_name(F.col("value")), names) == [True, True, False, False, True, False, True]


@pytest.mark.parametrize("pattern", rules.EXCLUDED_NAMES)
def test_each_exclusion(spark, pattern):
    name = pattern.rstrip("$")
    assert evaluate(spark, rules.excluded_name(F.col("value")), [name, "x" + name]) == [True, False]


TITLE_CASES = [
    ("Senior Data Analyst", "Data analyst", True),
    ("JUNIOR Data Analyst", "Data analyst", False),
    ("Data Analyst (not junior)", "Data analyst", False),
    ("Metadata analyst", "Data analyst", False),
    ("Database analyst", "Data analyst", False),
    ("Data analysts", "Data analyst", False),
    ('"Data" analyst', '"Data analyst"', True),
    ("старший АНАЛИТИК больших данных", "Аналитик данных OR Data analyst", True),
    ("бизнес-аналитик", "Бизнес аналитик OR Business Analyst", True),
    ("Chief Business Intelligence Officers", "Business Intelligence Officer", True),
    ("Head of BI", "Head of analytics OR Head of BI", True),
    ("Ahead of BI", "Head of analytics OR Head of BI", False),
    ("Head of analytics", "Руководитель отдела аналитики OR Head of analytics OR Head of BI", False),
    (None, "Data analyst", False),
    ("Data analyst", None, False),
]


def test_title_rules(spark):
    column = rules.title_matches(F.col("title"), F.col("query"))
    found = evaluate(spark, column, [c[:2] for c in TITLE_CASES], "title string, query string")
    assert found == [c[2] for c in TITLE_CASES]


def test_queries_without_rules_are_told_apart(spark):
    values = ['"Data analyst"', "Cook", None]
    assert evaluate(spark, rules.has_title_rules(F.col("value")), values) == [True, False, False]


@pytest.mark.parametrize(("phrase", "unit"), list(salary.PERIODS.items()))
def test_each_period(spark, phrase, unit):
    [found] = evaluate(spark, salary.split_period(F.col("value")), [f"$100 {phrase}"])
    assert (found["period"], found["text"]) == (unit, "$100 ")


def test_last_period_wins_and_all_go(spark):
    found = evaluate(spark, salary.split_period(F.col("value")), ["10 a week a year", "none", None])
    assert [tuple(f) for f in found] == [("10  ", "week"), ("none", ""), (None, "")]


@pytest.mark.parametrize(("sign", "code"), salary.CURRENCY_SIGNS)
def test_each_currency(spark, sign, code):
    assert evaluate(spark, salary.currency_of(F.col("value")), [f"100 {sign}"]) == [code]
    assert evaluate(spark, salary.without_currency(F.col("value")), [f"{sign} 100 {sign}"]) == [" 100 "]


def test_currency_order(spark):
    values = ["R$ 5", "Rp. 5", "RON 5", "Rs5", "R5", "€5 or $5", "5"]
    assert evaluate(spark, salary.currency_of(F.col("value")), values) == ["BRL", "IDR", "RON", "INR", "ZAR", "USD", ""]


def test_amounts(spark):
    cases = [
        ("1.500", "month", 1500.0), ("1,500", "month", 1500.0), ("1’500", "year", 1500.0), ("12.50", "hour", 12.5),
        ("1.234.567", "hour", 1234567.0), ("12,50", "hour", 1250.0), (" 1 500 ", "day", 1500.0), ("", "month", None),
        ("abc", "month", None), ("12d", "month", None), ("1e5", "month", None), (" 70 ", "month", 70.0),
    ]
    column = salary.amount(F.col("value"), F.col("period"))
    assert evaluate(spark, column, [c[:2] for c in cases], "value string, period string") == [c[2] for c in cases]


def test_ranges(spark):
    values = ["1 - 2 - 3", "4~5", "6", "-7", "1-2~3"]
    assert evaluate(spark, salary.range_bound(F.col("value"), 1), values) == ["1 ", "4", "6", "", "1"]
    assert evaluate(spark, salary.range_bound(F.col("value"), -1), values) == [" 3", "5", "6", "7", "2~3"]


def test_clean_amounts(spark):
    values = ["Up to 30万", "From {5}\n", "월급 収 9"]
    assert evaluate(spark, salary.clean_amounts(F.col("value")), values) == [" 300000", " 5", "  9"]


def test_month_factors(spark):
    units = ["hour", "day", "week", "month", "year", ""]
    assert evaluate(spark, salary.month_factor(F.col("value")), units) == [160, 20, 4, 1, 1 / 12, None]
