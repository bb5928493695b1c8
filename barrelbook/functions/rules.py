"""Name and title rules of the vacancy feeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that start with one of these patterns are not wanted.
EXCLUDED_NAMES = (
    r"курьер", r"грузчик", r"врач", r"менеджер по закупу",
    r"менеджер по продажам", r"оператор", r"повар", r"продавец",
    r"директор магазина", r"директор по продажам", r"директор по маркетингу",
    r"кабельщик", r"начальник отдела продаж", r"заместитель", r"администратор магазина",
    r"категорийный", r"аудитор", r"юрист", r"контент", r"супервайзер", r"стажер-ученик",
    r"су-шеф", r"маркетолог$", r"региональный", r"ревизор", r"экономист", r"ветеринар",
    r"торговый", r"клиентский", r"начальник цеха", r"территориальный", r"переводчик",
    r"маркетолог /", r"маркетолог по",
)

# Which titles belong to a search query.
TITLE_RULES = {
    "Руководитель data science OR Head of data science": (
        r".*\bРуководитель\b.*\bdata\b.*\bscience\b.*",
        r".*\bHead\b.*\bof\b.*\bdata\b.*\bscience\b.*",
    ),
    "Head of data science": (r".*\bHead\b.*\bof\b.*\bdata\b.*\bscience\b.*",),
    "Руководитель направления предиктивной аналитики": (
        r".*\bРуководитель\b.*\bнаправления\b.*\bпредиктивной\b.*\bаналитики\b.*",
    ),
    "Аналитик BI OR BI Analyst": (
        r".*\bАналитик\b.*\bBI\b.*",
        r".*\bBI\b.*\bAnalyst\b.*",
        r".*\bbusiness\b.*\bintelligence\b.*\banalyst\b.*",
    ),
    "BI Analyst": (r".*\bBI\b.*\bAnalyst\b.*", r".*\bbusiness\b.*\bintelligence\b.*\banalyst\b.*"),
    "Директор по визуализации OR Директор по аналитической отчетности OR Business Intelligence Officer": (
        r".*\bДиректор\b.*\bпо\b.*\bвизуализации\b.*",
        r".*\bДиректор\b.*\bпо\b.*\bаналитической\b.*\bотчетности\b.*",
        r".*\bBusiness\b.*\bIntelligence\b.*\bOfficer\b.*",
    ),
    "Аналитик баз данных OR Database analyst": (
        r".*\bАналитик\b.*\bбаз\b.*\bданных\b.*",
        r".*\bDatabase\b.*\banalyst\b.*",
    ),
    "Database analyst": (r".*\bDatabase\b.*\banalyst\b.*", r".*\bdata\b.*\bbase\b.*\banalyst\b.*"),
    "Разработчик BI OR BI Developer": (
        r".*\bРазработчик\b.*\bBI\b.*",
        r".*\bBI\b.*\bDeveloper\b.*",
        r".*\bbusiness\b.*\bintelligence\b.*\bdeveloper\b.*",
    ),
    "BI Developer": (r".*\bBI\b.*\bDeveloper\b.*", r".*\bbusiness\b.*\bintelligence\b.*\bdeveloper\b.*"),
    "Инженер баз данных OR DWH Engineer": (
        r".*\bИнженер\b.*\bбаз\b.*\bданных\b.*",
        r".*\bDWH\b.*\bEngineer\b.*",
    ),
    "DWH Engineer": (r".*\bDWH\b.*\bEngineer\b.*",),
    "Продуктовый аналитик OR Product Analyst": (
        r".*\bПродуктовый\b.*\bаналитик\b.*",
        r".*\bProduct\b.*\bAnalyst\b.*",
    ),
    "Product Analyst": (r".*\bProduct\b.*\bAnalyst\b.*",),
    "Data scientist OR Machine Learning specialist": (
        r".*\bData\b.*\bscientist\b.*",
        r".*\bMachine\b.*\bLearning\b.*\bspecialist\b.*",
    ),
    "Аналитик данных OR Data analyst": (
        r".*\bАналитик\b.*\bданных\b.*",
        r"^(?!.*junior).*\bdata\b.*\banalyst\b",
    ),
    "Data analyst": (r"^(?!.*junior).*\bdata\b.*\banalyst\b",),
    "Marketing Analyst": (r".*\bMarketing\b.*\bAnalyst\b.*",),
    "Business Intelligence Officer": (r".*\bBusiness\b.*\bIntelligence\b.*\bOfficer.*",),
    "Marketing Analyst OR Маркетинговый аналитик": (
        r".*\bМаркетинговый\b.*\bаналитик\b.*",
        r".*\bMarketing\b.*\bAnalyst\b.*",
    ),
    "Бизнес аналитик OR Business Analyst": (r".*\bБизнес\b.*\bаналитик\b.*", r"Business Analyst"),
    "Business Analyst": (r".*\bBusiness\b.*\bAnalyst\b.*",),
    "Junior Data Analyst": (r".*\bJunior\b.*\bData\b.*\bAnalyst\b.*",),
    "Head of analytics OR Head of BI": (
        r".*\bHead\b.*\bof\b.*\banalytics\b.*",
        r".*\bHead\b.*\bof\b.*\bBI\b.*",
        r".*\bHead\b.*\bof\b.*\bbusiness\b.*\bintelligence\b.*",
    ),
}

# Unicode-aware case folding and word boundaries; without them Cyrillic would be
# compared case-sensitively and have no word boundaries.
_FLAGS = "(?iuU)"


def excluded_name(name: Column, patterns: Sequence[str] = EXCLUDED_NAMES) -> Column:
    """Whether a vacancy name starts with an unwanted pattern (case-sensitive)."""
    return name.rlike("^(?:" + "|".join(patterns) + ")")


def has_title_rules(query: Column, rules: Mapping[str, Sequence[str]] = TITLE_RULES) -> Column:
    """Whether the query, without double quotes, has rules at all."""
    return F.coalesce(F.translate(query, '"', "").isin(list(rules)), F.lit(False))


def title_matches(
    title: Column, query: Column, rules: Mapping[str, Sequence[str]] = TITLE_RULES
) -> Column:
    """Whether any rule of the row's query occurs in the title, ignoring case.

    One precompiled alternation per query in a ``CASE``: neither a join with the rule
    table nor a per-row regex compilation. Queries without rules accept nothing.
    """
    key, text = F.translate(query, '"', ""), F.translate(title, '"', "")
    accepted = F.lit(False)
    for name, patterns in reversed(list(rules.items())):
        # A search finds a pattern anywhere, so leading and trailing wildcards only cost time.
        pattern = _FLAGS + "(?:" + "|".join(p.removeprefix(".*").removesuffix(".*") for p in patterns) + ")"
        accepted = F.when(key == name, text.rlike(pattern)).otherwise(accepted)
    return F.coalesce(accepted, F.lit(False))
