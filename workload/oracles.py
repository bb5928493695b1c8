"""The registered queries in SQL, written from their definitions on the given tables."""

from __future__ import annotations

from barrelbook.functions import rules, salary
from barrelbook.functions import text as skills
from barrelbook.plans import vacancies

from . import derived as d

ORACLES: dict[str, str] = {}

REVIEWS = """reviews AS (
  SELECT l_partkey AS beer_id, l_suppkey AS brewery_id, o_custkey AS venue_id,
         l_quantity AS rating_score, l_shipdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
VENUES = """venues AS (
  SELECT c_custkey AS venue_id, c_name AS venue_name, n_name AS venue_city, r_name AS venue_country,
         n_nationkey AS region_id, n_name AS region_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

NOW = "created_at >= DATE '2001-06-30' - INTERVAL 180 DAY AND created_at < DATE '2001-06-30' + INTERVAL 1 DAY"
BEFORE = (
    "created_at >= DATE '2001-06-30' - INTERVAL 360 DAY AND created_at <= DATE '2001-06-30' - INTERVAL 180 DAY"
)


def half_even(value: str, digits: int) -> str:
    """Round a non-negative double half to even on its shortest decimal form."""
    exact, power = f"CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 20))", 10**digits
    kept = f"trunc({exact} * {power})"
    return (
        f"CAST(CASE WHEN {exact} * {power} - {kept} = 0.5 AND CAST({kept} AS BIGINT) % 2 = 0 "
        f"THEN CAST({kept} AS BIGINT) / {power} ELSE round({exact}, {digits}) END AS DOUBLE)"
    )


def trophy(rank: str) -> str:
    return f"CASE WHEN {rank} <= 3 THEN '🏆 ' ELSE '' END || CAST({rank} AS VARCHAR)"


def movement(before: str, now: str) -> str:
    return (
        f"CASE WHEN {before} > {now} THEN '↑ +' || CAST({before} - {now} AS VARCHAR) "
        f"WHEN {before} < {now} THEN '↓ -' || CAST({now} - {before} AS VARCHAR) ELSE '–' END"
    )


def _brewery_top(window: str) -> str:
    return f"""
  SELECT *, row_number() OVER (ORDER BY mean DESC, brewery_id) AS rank FROM (
    SELECT brewery_id, sum(rating_score) / count(rating_score) AS mean, count(rating_score) AS checkins
    FROM reviews JOIN venues USING (venue_id)
    WHERE venue_country = 'EUROPE' AND {window}
    GROUP BY brewery_id HAVING count(rating_score) >= 5
    ORDER BY mean DESC, brewery_id LIMIT 25)"""


ORACLES["brewery_leaderboard"] = f"""
WITH {REVIEWS}, {VENUES},
now AS ({_brewery_top(NOW)}),
before AS ({_brewery_top(BEFORE)})
SELECT {trophy('now.rank')} AS place, now.brewery_id, s_name AS brewery_name,
       {half_even('now.mean', 2)} AS avg_rating, {movement('before.rank', 'now.rank')} AS movement,
       now.checkins, now.rank, before.rank AS previous_rank
FROM now LEFT JOIN before ON now.brewery_id = before.brewery_id JOIN supplier ON s_suppkey = now.brewery_id
"""

ORACLES["brewery_leaderboard_display"] = f"""
SELECT place AS "МЕСТО", brewery_name AS "НАЗВАНИЕ", avg_rating AS "РЕЙТИНГ", movement AS "ИЗМЕНЕНИЕ", checkins AS "ЧЕКИНОВ"
FROM ({ORACLES["brewery_leaderboard"]})
"""

ORACLES["brewery_leaderboard_prev"] = f"""
WITH {REVIEWS}, {VENUES} SELECT * FROM ({_brewery_top(BEFORE)})
"""


def _city_board(window: str) -> str:
    return f"""
  SELECT *, row_number() OVER (PARTITION BY board_city ORDER BY mean DESC, brewery_id, venue_city) AS rank FROM (
    SELECT CASE WHEN venue_city = 'NATION_8' THEN 'NATION_3' ELSE venue_city END AS board_city,
           venue_city, brewery_id,
           sum(rating_score) / count(rating_score) AS mean, count(rating_score) AS checkins
    FROM reviews JOIN venues USING (venue_id)
    WHERE venue_country = 'EUROPE' AND {window}
    GROUP BY ALL)"""


CITY_BOARD = f"""
{REVIEWS}, {VENUES},
now AS ({_city_board(NOW)}),
before AS (
  SELECT board_city, brewery_id, any_value(rank) AS rank FROM ({_city_board(BEFORE)})
  GROUP BY ALL HAVING count(*) = 1),
board AS (
  SELECT now.board_city, now.brewery_id, s_name AS brewery_name, now.venue_city,
         {half_even('now.mean', 2)} AS avg_rating, {movement('before.rank', 'now.rank')} AS movement,
         now.checkins, now.rank
  FROM now LEFT JOIN before ON now.board_city = before.board_city AND now.brewery_id = before.brewery_id
  JOIN supplier ON s_suppkey = now.brewery_id)"""

ORACLES["city_leaderboard"] = f"WITH {CITY_BOARD} SELECT * FROM board"

ORACLES["city_leaderboard_view"] = f"""
WITH {CITY_BOARD},
renamed AS (
  SELECT * REPLACE (CASE WHEN venue_city = 'NATION_8' THEN 'NATION_3' ELSE venue_city END AS venue_city)
  FROM board WHERE checkins >= 2),
single AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY board_city, brewery_name, venue_city ORDER BY rank) AS nth FROM renamed)
  WHERE nth = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY board_city ORDER BY rank) AS n FROM single)
SELECT board_city, {trophy('n')} AS place, brewery_name, venue_city, avg_rating, movement, checkins
FROM numbered WHERE n <= 10
"""


def _best(window: str) -> str:
    return f"""
  SELECT *, row_number() OVER (ORDER BY mean DESC, beer_id, brewery_id) AS rank FROM (
    SELECT l_partkey AS beer_id, p_name AS beer_name, l_suppkey AS brewery_id,
           sum(l_quantity) / count(l_quantity) AS mean, count(l_quantity) AS checkins
    FROM (SELECT *, l_shipdate AS created_at FROM lineitem) JOIN part ON l_partkey = p_partkey
    WHERE p_type IN (SELECT DISTINCT p_type FROM part) AND {window} GROUP BY ALL)"""


def _worst(window: str) -> str:
    return f"""
  SELECT *, row_number() OVER (ORDER BY mean, beer_id, brewery_id) AS rank FROM (
    SELECT l_partkey AS beer_id, l_suppkey AS brewery_id,
           sum(l_quantity) / count(l_quantity) AS mean, count(l_quantity) AS checkins
    FROM (SELECT *, l_shipdate AS created_at FROM lineitem)
    WHERE {window} GROUP BY ALL)"""


def _single_rank(ranked: str) -> str:
    return f"SELECT beer_id, any_value(rank) AS rank FROM ({ranked}) GROUP BY beer_id HAVING count(*) = 1"


_BEER_COLUMNS = f"""beer_id, beer_name, brewery_id, s_name AS brewery_name,
       {half_even('mean', 2)} AS avg_rating, {movement('before.rank', 'now.rank')} AS movement,
       checkins, now.rank
FROM now LEFT JOIN before USING (beer_id) JOIN supplier ON s_suppkey = brewery_id"""

BEST = f"now AS ({_best(NOW)}), before AS ({_single_rank(_best(BEFORE))}), board AS (SELECT {_BEER_COLUMNS})"
WORST = f"""
ranked AS ({_worst(NOW)}),
now AS (
  SELECT ranked.*, p_name AS beer_name FROM ranked JOIN part ON beer_id = p_partkey
  WHERE beer_id IN (SELECT beer_id FROM ranked GROUP BY beer_id HAVING count(*) = 1)),
before AS ({_single_rank(_worst(BEFORE))}), board AS (SELECT {_BEER_COLUMNS})"""

ORACLES["best_beers"] = f"WITH {BEST} SELECT * FROM board"
ORACLES["worst_beers"] = f"WITH {WORST} SELECT * FROM board"


def _beers_view(board: str, min_checkins: int) -> str:
    return f"""
WITH {board},
numbered AS (SELECT *, row_number() OVER (ORDER BY rank) AS n FROM board WHERE checkins >= {min_checkins})
SELECT {trophy('n')} AS place, beer_name, brewery_name, avg_rating, movement, checkins
FROM numbered WHERE n <= 10"""


ORACLES["best_beers_view"] = _beers_view(BEST, 2)
ORACLES["worst_beers_view"] = _beers_view(WORST, 1)
ORACLES["beer_styles"] = "SELECT DISTINCT p_type AS beer_style FROM part"


def _venue_top(window: str) -> str:
    return f"""
  SELECT *, row_number() OVER (ORDER BY checkins DESC, venue_id) AS rank FROM (
    SELECT venue_id, venue_name, venue_city, count(*) AS checkins
    FROM reviews JOIN venues USING (venue_id)
    WHERE venue_country = 'EUROPE' AND {window} GROUP BY ALL
    ORDER BY checkins DESC, venue_id LIMIT 10)"""


ORACLES["top_venues"] = f"""
WITH {REVIEWS}, {VENUES}, now AS ({_venue_top(NOW)}), before AS ({_venue_top(BEFORE)})
SELECT {trophy('now.rank')} AS place, now.venue_id, now.venue_name, now.venue_city,
       {movement('before.rank', 'now.rank')} AS movement, now.checkins, now.rank
FROM now LEFT JOIN before ON now.venue_id = before.venue_id
"""


def _scatter(direction: str, top_n: int) -> str:
    label = (
        "s_name || ',<br>количество сортов пива: ' || CAST(beer_count AS VARCHAR)"
        if direction == "ASC"
        else "'<b>' || s_name || '</b>,<br>сварили ' || CAST(beer_count AS VARCHAR) || "
        "' сортов пива<br>получили ' || CAST(rating_count AS VARCHAR) || "
        f"' чекина<br>со средним рейтингом ' || CAST({half_even('brewery_pure_average', 2)} AS VARCHAR)"
    )
    return f"""
means AS (
  SELECT l_suppkey AS brewery_id, sum(l_quantity) / count(l_quantity) AS brewery_pure_average,
         count(l_quantity) AS rating_count
  FROM (SELECT *, l_shipdate AS created_at FROM lineitem) WHERE {NOW}
  GROUP BY l_suppkey HAVING count(l_quantity) >= 45
  ORDER BY brewery_pure_average {direction}, brewery_id LIMIT {top_n}),
described AS (
  SELECT means.*, s_name, (s_suppkey * 7) % 60 AS beer_count, ((s_suppkey * 37) % 4000) / 365 AS age_on_service
  FROM means JOIN supplier ON s_suppkey = brewery_id),
scatter AS (
  SELECT brewery_id, brewery_pure_average, rating_count, s_name AS brewery_name, beer_count, age_on_service,
         {label} AS name_count,
         CAST(CASE WHEN beer_count < 10 THEN 7 WHEN beer_count <= 30 THEN 9 WHEN beer_count <= 50 THEN 11
              ELSE 13 END AS BIGINT) AS bucket_beer_count,
         CAST(CASE WHEN age_on_service < 4 THEN 0 WHEN age_on_service <= 6 THEN 1 WHEN age_on_service < 8 THEN 2
              ELSE 3 END AS BIGINT) AS bucket_age
  FROM described)"""


ORACLES["brewery_scatter"] = f"WITH {_scatter('DESC', 100)} SELECT * FROM scatter"
ORACLES["brewery_scatter_worst"] = f"WITH {_scatter('ASC', 20)} SELECT * FROM scatter"
ORACLES["scatter_medians"] = f"""
WITH {_scatter('DESC', 100)}
SELECT median(brewery_pure_average) AS median_average, CAST(median(rating_count) AS DOUBLE) AS median_count,
       'Медианное значение: ' || CAST({half_even('median(brewery_pure_average)', 2)} AS VARCHAR) AS average_label,
       'Медианное значение: ' || CAST(CAST(median(rating_count) AS DOUBLE) AS VARCHAR) AS count_label
FROM scatter"""
ORACLES["scatter_with_medians"] = f"""
WITH {_scatter('DESC', 100)}
SELECT brewery_id, median(brewery_pure_average) OVER () AS median_average,
       CAST(median(rating_count) OVER () AS DOUBLE) AS median_count
FROM scatter"""

ORACLES["line_item_medians"] = """
SELECT CAST(median(l_quantity) AS DOUBLE) AS l_quantity, CAST(median(l_extendedprice) AS DOUBLE) AS l_extendedprice,
       CAST(median(l_discount) AS DOUBLE) AS l_discount, CAST(median(l_orderkey) AS DOUBLE) AS l_orderkey
FROM lineitem
"""
ORACLES["share_sum_mean"] = f"""
WITH recent AS (
  SELECT l_partkey AS beer_id, l_suppkey AS brewery_id, l_quantity AS score
  FROM (SELECT *, l_shipdate AS created_at FROM lineitem) WHERE {NOW}),
beers AS (SELECT beer_id, brewery_id, sum(score) AS total FROM recent GROUP BY ALL),
breweries AS (SELECT brewery_id, count(score) AS rating_count FROM recent GROUP BY ALL)
SELECT brewery_id, rating_count, round(sum(total / rating_count), 6) AS brewery_pure_average
FROM beers JOIN breweries USING (brewery_id) GROUP BY ALL
"""

ORACLES["region_rating"] = f"""
WITH {REVIEWS}, {VENUES},
triples AS (
  SELECT beer_id, venue_id, region_id, region_name, rating_score
  FROM reviews LEFT JOIN venues USING (venue_id) GROUP BY ALL)
SELECT CAST(region_id AS BIGINT) AS region_id, region_name,
       sum(rating_score) / count(rating_score) AS beer_pure_avg
FROM triples GROUP BY ALL
"""


# Country-year panel ----------------------------------------------------------------

LOCATED = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

PANEL = f"""
quotes AS (
  SELECT n_name AS name, o_totalprice AS local_price, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS dollar_ex,
         'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso_a3, CAST(o_orderdate AS DATE) AS date
  FROM {LOCATED}),
yearly AS (
  SELECT name, year, iso_a3, local_price / dollar_ex AS dollar_price FROM (
    SELECT *, year(date) AS year,
           row_number() OVER (PARTITION BY name, year(date) ORDER BY date, local_price, dollar_ex, iso_a3) AS nth
    FROM quotes WHERE date >= DATE '1995-01-01' AND date < DATE '2003-01-01')
  WHERE nth = 1),
continents AS (
  SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso_a3, r_name AS continent
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> 'NATION_7'
  UNION ALL
  SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), 'ANTARCTICA' FROM nation
  WHERE n_name IN ('NATION_3', 'NATION_11')),
located AS (
  SELECT name, year, dollar_price,
         CASE WHEN (SELECT count(*) FROM continents c WHERE c.iso_a3 = yearly.iso_a3) = 1
              THEN (SELECT max(continent) FROM continents c WHERE c.iso_a3 = yearly.iso_a3)
              ELSE 'Europe' END AS continent
  FROM yearly),
domain AS (
  SELECT name, continent, year FROM
    (SELECT name, arg_min(continent, year) AS continent FROM located GROUP BY name)
    CROSS JOIN (SELECT unnest(range(1995, 2003)) AS year)),
population AS (
  SELECT n_name AS name, year, CAST(people * (year - 1990) AS DOUBLE) AS population
  FROM (SELECT n_name, count(*) AS people FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
  CROSS JOIN (SELECT unnest(range(1995, 2003)) AS year)),
gdp AS (
  SELECT n_name AS name, year(o_orderdate) AS year, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS DOUBLE) AS gdp
  FROM {LOCATED} WHERE n_name <> 'NATION_9' GROUP BY ALL),
panel AS (
  SELECT name, year, domain.continent, coalesce(dollar_price, 0) AS dollar_price,
         coalesce(population, 0) AS population, coalesce(gdp, 0) AS gdp,
         coalesce(gdp / population, 0) AS gdp_per_capita
  FROM domain LEFT JOIN located USING (name, year) LEFT JOIN population USING (name, year)
  LEFT JOIN gdp USING (name, year)
  WHERE name <> 'NATION_20')"""

ORACLES["continent_lookup"] = f"WITH {PANEL} SELECT name, year, continent FROM located"
ORACLES["panel_densified"] = f"""
WITH {PANEL} SELECT name, year, coalesce(dollar_price, 0) AS dollar_price FROM domain LEFT JOIN located USING (name, year)
"""
ORACLES["missing_years"] = f"""
SELECT n_name AS name, year FROM (SELECT DISTINCT n_name FROM {LOCATED})
CROSS JOIN (SELECT unnest(range(1990, 2003)) AS year)
WHERE (n_name, year) NOT IN (SELECT (n_name, year(o_orderdate)) FROM {LOCATED})
"""
ORACLES["wide_to_long_join"] = f"""
WITH {PANEL} SELECT name, year, gdp FROM yearly LEFT JOIN gdp USING (name, year)
"""
ORACLES["price_panel"] = f"WITH {PANEL} SELECT * FROM panel"
ORACLES["motion_frames"] = f"""
WITH {PANEL}
SELECT year, continent, row_number() OVER (PARTITION BY year, continent ORDER BY name) - 1 AS position, name AS text,
       population AS x, gdp_per_capita AS y, dollar_price * 20000000 AS size,
       {half_even('dollar_price', 1)} AS customdata
FROM panel
"""

# Reusable steps ----------------------------------------------------------------------

ORACLES["any_left_join_lookup"] = """
WITH first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders)
  WHERE nth = 1)
SELECT c_custkey, c_name, o_orderkey, coalesce(o_orderstatus, 'none') AS o_orderstatus
FROM customer LEFT JOIN first ON c_custkey = o_custkey
"""
ORACLES["dict_lookup_default"] = """
SELECT o_orderkey, o_custkey AS c_custkey, coalesce(c_name, '') AS c_name
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
"""
ORACLES["lookup_exactly_one"] = """
WITH single AS (
  SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders
  WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey HAVING count(*) = 1)
SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN single ON c_custkey = o_custkey
"""
ORACLES["anti_join_new_keys"] = """
SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events) e
WHERE nth = 1 AND NOT EXISTS (
  SELECT 1 FROM events s WHERE s.value > 250 AND s.user_id = e.user_id AND s.event_type = e.event_type)
"""
ORACLES["semi_join_styles"] = """
SELECT p_partkey AS beer_id, p_name AS beer_name, p_type AS beer_style FROM part
WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)
"""
ORACLES["alias_normalisation"] = """
WITH renamed AS (
  SELECT n_nationkey, CASE WHEN n_name IN ('NATION_1', 'NATION_11') THEN 'ONE' ELSE n_name END AS n_name FROM nation)
SELECT n_name, count(c_custkey) AS customers, count(DISTINCT n_nationkey) AS spellings
FROM renamed JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name
"""
ORACLES["dedup_keep_first"] = """
SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS nth FROM events)
WHERE nth = 1
"""
ORACLES["dedup_drop_all"] = """
SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL HAVING count(*) = 1
"""
ORACLES["latest_by_key"] = """
SELECT user_id, event_id, event_type, props FROM events
WHERE (user_id, event_id) IN (SELECT (user_id, max(event_id)) FROM events GROUP BY user_id)
"""
ORACLES["row_ids_after_max"] = """
SELECT (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F')
         + row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_idx,
       o_orderkey, o_totalprice
FROM orders WHERE o_orderstatus <> 'F'
"""
ORACLES["rows_after_offset"] = "SELECT p_partkey, p_name FROM part ORDER BY p_size DESC, p_partkey OFFSET 30"
ORACLES["union_by_name"] = """
SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier
"""

# Rules and salary texts ----------------------------------------------------------------

NAME = f"replace(replace({d.vacancy_name('o_orderkey')}, '''', ''), '\"', '')"
ORACLES["name_exclusion"] = f"""
SELECT posting_id, name, regexp_matches(name, '^({"|".join(rules.EXCLUDED_NAMES)})') AS excluded
FROM (SELECT o_orderkey AS posting_id, {NAME} AS name FROM {LOCATED})
"""


def _words(*words: str) -> str:
    """Whole words in this order, at any distance; RE2 word boundaries know ASCII only."""
    edge = r"[^\p{L}\p{N}_]"
    return f"(?i)(^|{edge})" + f"({edge}.*{edge}|{edge})".join(words) + f"({edge}|$)"


def _any_words(title: str, *phrases: str) -> str:
    return " OR ".join(f"regexp_matches({title}, '{_words(*p.split())}')" for p in phrases)


_ANALYST = "(regexp_matches(plain, '{0}') AND NOT contains(lower(plain), 'junior'))".format(
    _words("data", "analyst")
)
TITLE_ACCEPTED = f"""CASE query
  WHEN 'Data analyst' THEN {_ANALYST}
  WHEN '"BI Analyst"' THEN {_any_words('plain', 'BI Analyst', 'business intelligence analyst')}
  WHEN '"Аналитик данных" OR "Data analyst"' THEN {_any_words('plain', 'Аналитик данных')} OR {_ANALYST}
  WHEN 'Head of analytics OR Head of BI'
    THEN {_any_words('plain', 'Head of analytics', 'Head of BI', 'Head of business intelligence')}
  WHEN 'Junior Data Analyst' THEN {_any_words('plain', 'Junior Data Analyst')}
  ELSE false END"""
ORACLES["title_rules"] = f"""
SELECT posting_id, title, query <> 'Query without rules' AS has_rules, {TITLE_ACCEPTED} AS accepted
FROM (SELECT *, replace(title, '"', '') AS plain FROM (
  SELECT o_orderkey AS posting_id, {d.query('o_orderkey')} AS query, {d.title('o_orderkey')} AS title FROM {LOCATED}))
"""


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _skills(text: str) -> str:
    return f"array_to_string(list_filter({_list(skills.SKILLS)}, lambda k: contains(lower({text}), k)), ',')"


ORACLES["skill_tags"] = f"SELECT doc_id, {_skills('text')} AS skills FROM documents"


def _currency(text: str, part: int) -> str:
    cases = " ".join(f"WHEN contains({text}, '{entry[0]}') THEN '{entry[part]}'" for entry in salary.CURRENCY_SIGNS)
    return f"CASE {cases} ELSE '' END"


ORACLES["currency_detect"] = f"SELECT doc_id, {_currency('text', 1)} AS currency FROM documents"


def _split(texts: str) -> str:
    """Period and remaining text: a fold over the phrases, the text being its first element."""
    phrases = ", ".join("{'t': '%s', 'p': '%s'}" % (p.replace("'", "''"), u) for p, u in salary.PERIODS.items())
    return f"""
split AS (
  SELECT * EXCLUDE (s), s.p AS period, s.t AS rest FROM (
    SELECT *, list_reduce([{{'t': salary_text, 'p': ''}}, {phrases}],
      lambda acc, x: {{'t': replace(acc.t, x.t, ''), 'p': CASE WHEN contains(acc.t, x.t) THEN x.p ELSE acc.p END}}) AS s
    FROM ({texts}) WHERE salary_text IS NOT NULL)
  UNION ALL BY NAME SELECT *, '' AS period, CAST(NULL AS VARCHAR) AS rest FROM ({texts}) WHERE salary_text IS NULL),
signed AS (
  SELECT *, {_currency('rest', 1)} AS currency, replace(rest, {_currency('rest', 0)}, '') AS body FROM split),
cleaned AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(body, '万', '0000'), '収', ''), '월급', ''),
    'Up to', ''), 'From', ''), '{{', ''), '}}', ''), chr(10), '') AS amounts FROM signed),
bounds AS (
  SELECT *, CASE WHEN contains(amounts, '-') THEN string_split(amounts, '-') ELSE string_split(amounts, '~') END AS parts
  FROM cleaned),
amounts AS (
  SELECT * EXCLUDE (parts), {_number('parts[1]')} AS salary_from, {_number('parts[-1]')} AS salary_to FROM bounds)"""


def _number(part: str) -> str:
    dots = f"(length({part}) - length(replace({part}, '.', '')))"
    kept = f"CASE WHEN {dots} = 1 AND period = 'hour' THEN {part} ELSE replace({part}, '.', '') END"
    return f"try_cast(nullif(replace(replace(replace({kept}, ',', ''), ' ', ''), '’', ''), '') AS DOUBLE)"


SALARY_TEXTS = f"SELECT o_orderkey AS posting_id, {d.salary('o_orderkey')} AS salary_text FROM {LOCATED}"
ORACLES["period_detect"] = f"WITH {_split(SALARY_TEXTS)} SELECT posting_id, period, rest FROM split"
ORACLES["salary_range"] = f"WITH {_split(SALARY_TEXTS)} SELECT posting_id, currency, salary_from, salary_to FROM amounts"

COUNTRY = "CASE {0} {1} END".format(
    d.COUNTRY_CODE, " ".join(f"WHEN '{c}' THEN '{vacancies.COUNTRIES[c]}'" for c in d.CODES)
)
FACTOR = "CASE period WHEN 'hour' THEN 160 WHEN 'day' THEN 20 WHEN 'week' THEN 4 WHEN 'month' THEN 1 WHEN 'year' THEN CAST(1 AS DOUBLE) / 12 END"
RATE = "CASE currency WHEN 'USD' THEN 1 {0} END".format(
    " ".join(f"WHEN '{c}' THEN CAST({r} AS DOUBLE)" for c, r in {**salary.FALLBACK_USD_RATES, **d.RATES}.items())
)


def _priced(texts: str) -> str:
    """``texts``: salary_text, country, cost and keys."""
    return f"""texts AS ({texts}), {_split('SELECT * FROM texts')},
dollars AS (
  SELECT *, salary_from * ({FACTOR}) * ({RATE}) AS low, salary_to * ({FACTOR}) * ({RATE}) AS high,
         CASE WHEN period = '' THEN 'no_period' WHEN salary_from IS NULL AND salary_to IS NULL THEN 'bad_amount'
              WHEN ({RATE}) IS NULL THEN 'no_rate' WHEN cost IS NULL THEN 'no_index' ELSE 'ok' END AS salary_status
  FROM amounts WHERE salary_text IS NOT NULL),
priced AS (
  SELECT * EXCLUDE (salary_text, low, high, salary_status), 
         low AS "month_salary_from_USD", high AS "month_salary_to_USD",
         low * 12 AS "year_salary_from_USD", high * 12 AS "year_salary_to_USD",
         low / cost AS month_salary_from_bigmac, high / cost AS month_salary_to_bigmac,
         low / cost * 12 AS year_salary_from_bigmac, high / cost * 12 AS year_salary_to_bigmac,
         salary_status FROM dollars
  UNION ALL BY NAME SELECT * EXCLUDE (salary_text), 'no_salary' AS salary_status FROM texts WHERE salary_text IS NULL)"""


COST = "CASE WHEN n_name <> 'NATION_3' THEN CAST(2 + n_nationkey / 4 AS DOUBLE) END"
PRICED = _priced(f"""
  SELECT o_orderkey AS posting_id, {d.salary('o_orderkey')} AS salary_text, {COUNTRY} AS country, {COST} AS cost
  FROM {LOCATED}""")
ORACLES["salary_month_usd"] = f"""
WITH {PRICED} SELECT posting_id, salary_status, "month_salary_from_USD", "month_salary_to_USD",
  "year_salary_from_USD", "year_salary_to_USD" FROM priced
"""
ORACLES["salary_index_units"] = f"""
WITH {PRICED} SELECT posting_id, country, month_salary_from_bigmac, month_salary_to_bigmac,
  year_salary_from_bigmac, year_salary_to_bigmac FROM priced
"""


def _relative(text: str) -> str:
    return f"""CASE WHEN contains(lower({text}), '+') OR contains(lower({text}), 'более') THEN DATE '2021-01-18' - 32
      WHEN regexp_matches({text}, '(^|\\s)\\d+(\\s|$)')
      THEN DATE '2021-01-18' - CAST(regexp_extract({text}, '(^|\\s)(\\d+)(\\s|$)', 2) AS INT) END"""


ORACLES["relative_dates"] = f"""
SELECT posting_id, CAST({_relative('date_text')} AS VARCHAR) AS day
FROM (SELECT o_orderkey AS posting_id, {d.date_text('o_orderkey')} AS date_text FROM {LOCATED})
"""
ORACLES["sheet_names"] = """
SELECT o_orderkey, 'IND-Q' || CAST(quarter(o_orderdate) AS VARCHAR) || CAST(year(o_orderdate) AS VARCHAR) AS sheet
FROM orders
"""
ORACLES["result_counts"] = f"""
SELECT posting_id, CAST(replace(CASE code
    WHEN 'gr' THEN words[-3] WHEN 'kr' THEN regexp_replace(words[-1], '[^0-9]', '', 'g')
    WHEN 'ro' THEN words[4] WHEN 'vn' THEN string_split(words[2], '/')[-1] ELSE words[-2] END, ',', '') AS BIGINT) AS results
FROM (SELECT posting_id, code, string_split_regex(trim(caption), '\\s+') AS words FROM (
  SELECT o_orderkey AS posting_id, {d.COUNTRY_CODE} AS code, {d.caption(d.COUNTRY_CODE)} AS caption FROM {LOCATED}))
"""
ORACLES["keywords_by_country"] = f"""
WITH terms AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'ru' ELSE 'en' END AS language, p_name AS query FROM part)
SELECT country_code, language, query FROM (
  SELECT CASE WHEN n_nationkey = 4 THEN 'ru' ELSE {d.COUNTRY_CODE} END AS country_code FROM nation)
JOIN terms ON language = CASE WHEN country_code = 'ru' THEN 'ru' ELSE 'en' END
"""

# Feeds -----------------------------------------------------------------------------------

K, C, N = (f"CAST({column} AS VARCHAR)" for column in ("o_orderkey", "o_custkey", "n_nationkey"))
FEED = f"""feed AS (
  SELECT '2021-01-18 10:00:00' AS added_at, {d.query('o_orderkey')} AS query_string, 'Навык' AS query_type,
    CAST(NULL AS VARCHAR) AS level, 'Analytics' AS direction, {K} AS vacancy_id,
    CAST(o_orderkey % 2 = 0 AS INT) AS is_premium, CAST(o_orderkey % 3 = 0 AS INT) AS has_test,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'https://r/' || {K} END AS response_url,
    CASE WHEN o_orderkey % 5 <> 0 THEN n_name END AS address_city,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'S' || {C} END AS address_street,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 90 AS VARCHAR) END AS address_building,
    CAST(NULL AS VARCHAR) AS address_description,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST((o_orderkey % 180) / 2 AS DOUBLE) END AS address_lat,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST((o_custkey % 360) / 4 AS DOUBLE) END AS address_lng,
    CASE WHEN o_orderkey % 5 <> 0 THEN n_name || ', S' || {C} END AS address_raw,
    CASE WHEN o_orderkey % 5 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '[]'
      ELSE '[{{"station_id":"' || CAST(o_orderkey % 50 AS VARCHAR) || '","station_name":"' || n_name || '"}}]' END
      END AS address_metro_stations,
    'https://v/' || {K} AS alternate_url, 'https://apply/' || {K} AS apply_alternate_url,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 7 AS VARCHAR) END AS department_id,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Dept ' || CAST(o_orderkey % 7 AS VARCHAR) END AS department_name,
    CASE WHEN o_orderkey % 4 <> 1 AND o_orderkey % 8 <> 2 THEN {d.AMOUNT} % 60000 END AS salary_from,
    CASE WHEN o_orderkey % 4 <> 1 THEN {d.AMOUNT} END AS salary_to,
    CASE WHEN o_orderkey % 4 <> 1 THEN ['RUR', 'USD', 'EUR'][o_orderkey % 3 + 1] END AS salary_currency,
    CASE WHEN o_orderkey % 4 <> 1 THEN CAST(o_orderkey % 2 = 0 AS INT) END AS salary_gross,
    {NAME} AS name,
    CASE WHEN o_orderkey % 11 = 0 THEN {K} END AS insider_interview_id,
    CASE WHEN o_orderkey % 11 = 0 THEN 'https://i/' || {K} END AS insider_interview_url,
    'https://a/' || {N} AS area_url, {N} AS area_id, n_name AS area_name, 'https://api/' || {K} AS url,
    strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':15:00' AS published_at,
    'https://e/' || {C} AS employer_url, CAST(NULL AS VARCHAR) AS employer_alternate_url,
    CASE WHEN o_custkey % 2 = 0 THEN 'https://l90/' || {C} END AS employer_logo_urls_90,
    CASE WHEN o_custkey % 2 = 0 THEN 'https://l240/' || {C} END AS employer_logo_urls_240,
    CASE WHEN o_custkey % 2 = 0 THEN 'https://l/' || {C} END AS employer_logo_urls_original,
    c_name AS employer_name, CASE WHEN o_orderkey % 13 <> 0 THEN {C} END AS employer_id,
    CAST(o_orderkey % 5 = 1 AS INT) AS response_letter_required, 'open' AS type_id, 'Open' AS type_name,
    CAST(o_orderkey % 10 = 9 AS INT) AS is_archived,
    CASE WHEN o_orderkey % 7 <> 5
      THEN ['fullDay', 'remote', 'flyInFlyOut', 'shift'][o_orderkey % 4 + 1] END AS schedule,
    o_orderstatus
  FROM {LOCATED}),
judged AS (
  SELECT *, NOT (regexp_matches(name, '^({"|".join(rules.EXCLUDED_NAMES)})')
    OR coalesce(salary_currency = 'RUR' AND salary_from < 15000, false)
    OR is_archived = 1 OR coalesce(schedule = 'flyInFlyOut', false)) AS accepted FROM feed)"""

ORACLES["vacancy_feed_flatten"] = f"WITH {FEED} SELECT * EXCLUDE (o_orderstatus) FROM feed"
ORACLES["vacancy_feed_filters"] = f"WITH {FEED} SELECT vacancy_id, accepted FROM judged"
ORACLES["vacancy_feed"] = f"""
WITH {FEED}
SELECT * EXCLUDE (o_orderstatus, accepted) FROM judged WHERE accepted AND o_orderstatus <> 'F'
"""

CARDS = f"""cards AS (
  SELECT o_orderkey AS page_id, CAST(j AS BIGINT) AS position, query_string, o_orderstatus, country_code, cost, country,
    'p_' || CAST(number AS VARCHAR) AS element_id, chr(10) || {d.title('number')} AS title,
    CASE WHEN o_orderkey % 9 <> 0 THEN '/rc/' || CAST(number AS VARCHAR) END AS href,
    CASE WHEN o_orderkey % 7 <> 0 THEN chr(10) || c_name END AS company, n_name AS city,
    {d.summary('number')} AS summary, {d.date_text('number')} AS date_text, {d.salary('number')} AS salary_text,
    CASE WHEN j = 1 THEN 'Easily apply' END AS easy_label,
    CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 5 + 0.5 AS VARCHAR) END AS rating_text,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Remote' END AS remote_label
  FROM (SELECT *, o_orderkey * 2 + j AS number, {d.query('o_orderkey')} AS query_string,
               {d.COUNTRY_CODE} AS country_code, {COUNTRY} AS country, {COST} AS cost
        FROM {LOCATED} CROSS JOIN (SELECT unnest([0, 1]) AS j)) WHERE o_orderkey % 11 <> 0)"""
ORACLES["html_cards"] = f"""
WITH {CARDS} SELECT * EXCLUDE (query_string, o_orderstatus, country_code, country, cost) FROM cards
"""
POSTING = f"""query_string, country, replace(title, chr(10), '') AS title, replace(company, chr(10), '') AS company, city,
       CAST(coalesce({_relative('date_text')}, DATE '2021-01-18') AS VARCHAR) AS job_added,
       CAST(easy_label IS NOT NULL AS INT) AS easy_apply, CAST(rating_text AS DOUBLE) AS company_rating,
       CAST(remote_label IS NOT NULL AS INT) AS remote, substr(element_id, 3) AS job_id,
       'https://' || country_code || '.indeed.com' || href AS job_link, 'IND-Q12021' AS sheet,
       {_skills('summary')} AS skills, '2021-01-18' AS added_date,
       "month_salary_from_USD", "month_salary_to_USD", "year_salary_from_USD", "year_salary_to_USD",
       month_salary_from_bigmac, month_salary_to_bigmac, year_salary_from_bigmac, year_salary_to_bigmac"""
ORACLES["vacancy_salaries"] = f"""
WITH {CARDS},
{_priced(f'''SELECT *, replace(replace(title, chr(10), ''), '"', '') AS plain, query_string AS query FROM cards
  WHERE NOT (position = 0 AND o_orderstatus = 'F')''')},
accepted AS (SELECT * FROM priced WHERE {TITLE_ACCEPTED})
SELECT (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F')
         + row_number() OVER (ORDER BY query_string, substr(element_id, 3)) AS row_idx, {POSTING}
FROM accepted
"""

ORACLES["page_summaries"] = f"""
SELECT o_orderkey AS page_id, CAST(o_orderkey % 11 = 0 AS INT) AS bad_query, {d.AMOUNT} AS results FROM {LOCATED}
"""

# Accounts and catalogue --------------------------------------------------------------------

ACTIVITY = """
users AS (
  SELECT DISTINCT 'user' || CAST(conv_id AS VARCHAR) AS user_name, conv_id FROM conversations
  WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')),
newest AS (
  SELECT * FROM (
    SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth
    FROM conversations WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM users))),
posts AS (
  SELECT 'user' || CAST(conv_id AS VARCHAR) AS owner, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS code,
         conv_id, turn, text FROM newest WHERE turn <> 2)"""
ORACLES["accounts_by_query"] = """
SELECT DISTINCT 'user' || CAST(conv_id AS VARCHAR) AS user_name FROM conversations WHERE role IN ('user', 'assistant', 'system')
"""
ORACLES["account_activity"] = f"""
WITH {ACTIVITY}
SELECT user_name, CAST(users.conv_id % 2 = 0 AS INT) AS is_verified,
       CAST(coalesce(sum(turn), 0) AS BIGINT) AS total_comments,
       CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total_likes
FROM users LEFT JOIN posts ON owner = user_name GROUP BY ALL
"""
ORACLES["account_posts"] = f"""
WITH {ACTIVITY}
SELECT owner, code AS id, code, replace(replace(text, '''', ''), '"', '') AS caption, turn AS comments_count,
       length(text) AS likes_count,
       1609459200 + turn * 3600 + conv_id AS date,
       CAST(turn = 4 AS INT) AS is_video
FROM posts
"""
ORACLES["account_comments"] = f"""
WITH {ACTIVITY}
SELECT CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS id, code AS post_id, a.role AS owner,
       replace(replace(a.text, '''', ''), '"', '') AS text
FROM conversations a JOIN posts ON a.conv_id = posts.conv_id AND a.turn = posts.turn + 1
WHERE a.role = 'assistant'
"""

B = "CAST(substr(p_brand, 7) AS INT)"


def _enriched(row: str, liter: str, cost: str, where: str) -> str:
    return f"""
  SELECT p_partkey AS row, p_name || ' ' || p_brand AS name, p_name AS find,
    CASE WHEN {B} % 4 <> 0 THEN CAST({B} % 5 AS VARCHAR) || ',' || CAST({B} % 10 AS VARCHAR) END AS rating,
    CASE {B} % 3 WHEN 0 THEN '1' || CAST({B} AS VARCHAR) || ',5' WHEN 1 THEN CAST({B} AS VARCHAR) || ',25' END AS avg_price,
    CASE WHEN {B} % 6 = 0 THEN '1' || lpad(CAST({B} * 37 AS VARCHAR), 3, '0') ELSE CAST({B} * 37 AS VARCHAR) END AS ratings_count, {liter} AS liter, {cost} AS cost
  FROM part WHERE {where}"""


FIRST = _enriched("p_partkey", "CAST(CAST(p_size / 4 AS DOUBLE) AS VARCHAR)", "CAST(p_retailprice AS VARCHAR)", "true")
SECOND = _enriched("p_partkey", "'0.75'", "CAST(p_size AS VARCHAR)", "p_partkey % 10 <> 0")
ORACLES["catalogue_enrichment"] = f"""
SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY find ORDER BY row) AS nth FROM ({FIRST})) WHERE nth = 1
"""
ORACLES["catalogue_summary"] = f"""
SELECT * FROM ({FIRST}) UNION ALL SELECT * EXCLUDE (nth) FROM (
  SELECT *, row_number() OVER (PARTITION BY find ORDER BY row) AS nth FROM ({SECOND})) WHERE nth = 1
"""
ORACLES["transliterate"] = """
SELECT p_partkey AS row, p_name || ' ' || p_brand || ' Zhuk tsaplja chascha shilo schuka jula Jabloko ob''ezd' AS vine
FROM part WHERE p_partkey % 10 <> 0
"""
ORACLES["decimal_comma"] = """
SELECT p_partkey, p_retailprice AS value, replace(CAST(p_retailprice + 1 AS VARCHAR), '.', ',') AS next FROM part
"""

# Pages ---------------------------------------------------------------------------------------


def _unescaped(text: str) -> str:
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{character}')"
    return text


ORACLES["html_titles"] = f"""
SELECT page_id, CASE WHEN contains(html, '<title>')
  THEN trim({_unescaped("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) END AS title
FROM pages
"""


def _links(pattern: str) -> str:
    return f"""
SELECT page_id, CAST(generate_subscripts(targets, 1) - 1 AS BIGINT) AS position,
       {_unescaped('unnest(targets)')} AS href, {_unescaped("regexp_replace(unnest(texts), '<[^>]*>', '', 'g')")} AS text
FROM (SELECT page_id, regexp_extract_all(shown, '{pattern}', 1) AS targets,
             regexp_extract_all(shown, '{pattern}', 2) AS texts
      FROM (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') AS shown FROM pages))
"""


ORACLES["html_links"] = _links('(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>')
ORACLES["html_menu_items"] = _links('(?s)<li><a href="([^"]*)">(.*?)</a></li>')

# Files, tables and stored results -----------------------------------------------------------

ORACLES["csv_with_header"] = "SELECT * REPLACE ('\"N\", ' || c_name AS c_name) FROM customer"
ORACLES["csv_headerless"] = "SELECT * FROM part"
ORACLES["csv_after_preamble"] = f"""
WITH {PANEL}
SELECT name, {', '.join(f"max(gdp) FILTER (year = {y}) AS y{y}" for y in range(1995, 2003))}
FROM gdp GROUP BY name
"""
ORACLES["table_export"] = """
SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM orders
"""
FEED_TEXTS = """
    query_string query_type level direction vacancy_id response_url address_city address_street address_building
    address_description address_raw address_metro_stations alternate_url apply_alternate_url department_id
    department_name salary_currency name insider_interview_id insider_interview_url area_url area_id area_name url
    employer_url employer_alternate_url employer_logo_urls_90 employer_logo_urls_240 employer_logo_urls_original
    employer_name employer_id type_id type_name schedule
""".split()
ORACLES["vacancy_export_view"] = f"""
WITH {FEED}
SELECT * EXCLUDE (o_orderstatus) REPLACE ({', '.join(f"coalesce({c}, '') AS {c}" for c in FEED_TEXTS)}) FROM feed
"""
ORACLES["vacancy_export_job"] = ORACLES["vacancy_export_view"]
ORACLES["feed_from_files"] = f"""
WITH {FEED}
SELECT * EXCLUDE (o_orderstatus, added_at, query_string, query_type, level, direction) FROM feed
"""
ORACLES["append_sink"] = ORACLES["table_export"]
ORACLES["created_table_latest"] = "SELECT event_id AS row_idx, 2 AS version, value * 2 AS value FROM events"
ORACLES["partitioned_by_city"] = f"""
WITH {CITY_BOARD} SELECT * FROM board
"""
ORACLES["stored_or_computed"] = " UNION ALL ".join(
    f"SELECT '{source}' AS source, * FROM ({ORACLES['brewery_scatter']})" for source in ("stored", "computed")
)
ORACLES["daily_refresh"] = " UNION ALL BY NAME ".join(
    f"SELECT '{name}' AS name, * FROM ({ORACLES[key]})"
    for name, key in (
        ("cities", "city_leaderboard"),
        ("top_best_beers", "best_beers"),
        ("top_worst_beers", "worst_beers"),
        ("ratio_scatter_plot", "brewery_scatter"),
    )
)

ORACLES["incremental_refresh"] = ORACLES["daily_refresh"]
_EVEN = _scatter("DESC", 100).replace("FROM lineitem", "FROM (SELECT * FROM lineitem WHERE l_suppkey % 2 = 0)")
ORACLES["catalogued_results"] = f"""
WITH evens AS (WITH {_EVEN} SELECT brewery_id, rating_count, row_number() OVER (ORDER BY brewery_pure_average DESC, brewery_id) AS nth FROM scatter),
everything AS (WITH {_scatter("DESC", 100)} SELECT brewery_id, rating_count FROM scatter)
SELECT 0 AS step, 'miss' AS status, brewery_id, rating_count FROM evens
UNION ALL SELECT 1, 'hit', brewery_id, rating_count FROM evens
UNION ALL SELECT 2, 'miss', brewery_id, rating_count FROM evens WHERE nth <= 20
UNION ALL SELECT 3, 'stale', brewery_id, rating_count FROM everything
"""

# Streams --------------------------------------------------------------------------------------

ORACLES["stream_ingest_dedup"] = """
SELECT min(event_id) AS event_id, CASE WHEN user_id % 7 <> 0 THEN user_id END AS user_id, event_type,
       arg_min(value, event_id) AS value
FROM events GROUP BY CASE WHEN user_id % 7 <> 0 THEN user_id END, event_type
"""
ORACLES["stream_two_feeds"] = "SELECT event_id, ts, user_id, event_type, value FROM events"
ORACLES["stream_known_keys"] = "SELECT DISTINCT user_id, event_type FROM events"
for _name in ("stream_bounded_dedup", "stream_bounded_state", "stream_bucketed_keys"):
    ORACLES[_name] = "SELECT event_id, ts, user_id, event_type, value FROM events"
ORACLES["stream_vacancy_feed"] = f"WITH {FEED} SELECT * EXCLUDE (o_orderstatus, accepted) FROM judged WHERE accepted"
ORACLES["stream_postings"] = f"""
WITH {CARDS},
{_priced("""SELECT *, replace(replace(title, chr(10), ''), '"', '') AS plain, query_string AS query FROM cards""")}
SELECT {POSTING}
FROM priced WHERE {TITLE_ACCEPTED}
"""
