"""Data products on fixtures with the awkward cases, against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barrelbook.plans import accounts, catalogue, leaderboards, panel, regions, scatter, vacancies

AS_OF = "2021-03-01"
MIDNIGHT = datetime(2021, 3, 1)
REVIEW_DDL = "beer_id bigint, brewery_id bigint, venue_id bigint, rating_score double, created_at timestamp_ntz"


def make_reviews():
    """Missing venues and ratings, unknown venues, the shared instant, equal means, one hot
    brewery and one hot venue."""
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        brewery = 1 if rng.random() < 0.4 else rng.randint(2, 12)
        venue = 1 if rng.random() < 0.4 else rng.choice([None, 99, *range(2, 9)])
        score = None if rng.random() < 0.05 else rng.randint(0, 20) / 4
        days = rng.choice([0, 5, 29, 30, 31, 45, 59, 60, 61, 90])
        at = MIDNIGHT - timedelta(days=days) + timedelta(hours=rng.choice([0, 0, 7]))
        rows.append((rng.randint(1, 20) * 100 + brewery % 3, brewery, venue, score, at))
    rows.append((7, 13, 2, None, MIDNIGHT))  # a brewery without any rated check-in
    return rows


REVIEWS = make_reviews()
VENUES = [(v, "Москва" if v % 3 == 1 else "Moscow" if v % 3 == 2 else "Тула", "Россия" if v < 8 else "Latvia") for v in range(1, 9)]
BREWERIES = [(b, f"Brewery {b // 2}") for b in range(1, 12)]  # 12 and 13 unnamed; names repeat
BEERS = [(i * 100 + r, f"beer {i}", None if i == 4 else f"style {i % 3}") for i in range(1, 20) for r in range(3)]


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(REVIEWS, REVIEW_DDL).repartition(4)


@pytest.fixture(scope="module")
def venues(spark):
    twice = [*VENUES, (3, "Я", "Я")]  # a second row for one venue: the first by city counts
    return spark.createDataFrame(
        [(*v, v[0] % 3, f"region {v[0] % 3}", f"venue {v[0]}") for v in twice],
        "venue_id bigint, venue_city string, venue_country string, region_id bigint, region_name string, venue_name string",
    )


@pytest.fixture(scope="module")
def breweries(spark):
    return spark.createDataFrame([(*b, b[0] * 7) for b in BREWERIES], "brewery_id bigint, brewery_name string, beer_count int")


@pytest.fixture(scope="module")
def beers(spark):
    twice = [*BEERS, (500, "other name", "style 1")]
    return spark.createDataFrame(twice, "beer_id bigint, beer_name string, beer_style string")


def window(name):
    for beer, brewery, venue, score, at in REVIEWS:
        inside = (
            MIDNIGHT - timedelta(days=30) <= at < MIDNIGHT + timedelta(days=1)
            if name == "now"
            else MIDNIGHT - timedelta(days=60) <= at <= MIDNIGHT - timedelta(days=30)
        )
        if inside:
            yield beer, brewery, venue, score


def means(pairs):
    """key -> (mean or None, rated count) of (key, score) pairs."""
    groups = defaultdict(list)
    for key, score in pairs:
        groups[key].append(score)
    result = {}
    for key, scores in groups.items():
        rated = [s for s in scores if s is not None]
        result[key] = (sum(rated) / len(rated) if rated else None, len(rated))
    return result


def best_first(board):
    return sorted(board, key=lambda k: (board[k][0] is None, -(board[k][0] or 0), k))


def label(before, now):
    if before is None or before == now:
        return "–"
    return f"↑ +{before - now}" if before > now else f"↓ {before - now}"


def test_brewery_leaderboard(reviews, venues, breweries):
    home = {v for v, _, country in VENUES if country == "Россия"}

    def top(name):
        board = means((b, s) for _, b, v, s in window(name) if v in home)
        board = {b: m for b, m in board.items() if m[1] >= 20}
        return board, best_first(board)[:5]

    (now, ranks), (_, before) = top("now"), top("before")
    names = dict(BREWERIES)
    expected = [
        (names.get(b, ""), now[b][1], label(before.index(b) + 1 if b in before else None, n))
        for n, b in enumerate(ranks, 1)
    ]
    board = leaderboards.brewery_leaderboard(reviews, venues, breweries, AS_OF, min_checkins=20, k=5).collect()
    assert [(r["brewery_name"], r["checkins"], r["movement"]) for r in board] == expected
    assert [r["place"] for r in board] == ["🏆 1", "🏆 2", "🏆 3", "4", "5"]


@pytest.fixture
def city_board(reviews, venues, breweries):
    return leaderboards.city_leaderboard(reviews, venues, breweries, AS_OF)


def expected_city(city, spellings):
    places = {v: c for v, c, country in VENUES if country == "Россия" and c in spellings}

    def ranked(name):
        board = means(((b, places[v]), s) for _, b, v, s in window(name) if v in places)
        return board, best_first(board)

    (now, order), (_, before) = ranked("now"), ranked("before")
    several = Counter(b for b, _ in before)
    earlier = {b: n for n, (b, _) in enumerate(before, 1) if several[b] == 1}
    return [(city, b, c, now[b, c][1], n, label(earlier.get(b), n)) for n, (b, c) in enumerate(order, 1)]


def test_city_leaderboard(city_board):
    expected = expected_city("Москва", ["Москва", "Moscow"]) + expected_city("Тула", ["Тула", "Tula"])
    got = [
        (r["board_city"], r["brewery_id"], r["venue_city"], r["checkins"], r["rank"], r["movement"])
        for r in city_board.collect()
    ]
    assert sorted(got) == sorted(expected)
    assert any(r["avg_rating"] == 0 and r["checkins"] == 0 for r in city_board.collect())  # unrated, shown as 0


def test_city_view_orders_its_steps(city_board):
    stored = sorted((r.asDict() for r in city_board.collect() if r["board_city"] == "Москва"), key=lambda r: r["rank"])
    seen, expected = set(), []
    for row in stored:
        city = leaderboards.CITY_ALIASES.get(row["venue_city"], row["venue_city"])
        if row["checkins"] >= 5 and (row["brewery_name"], city) not in seen:
            seen.add((row["brewery_name"], city))
            expected.append((row["brewery_name"], city, row["checkins"]))
    view = leaderboards.city_leaderboard_view(city_board, "Москва", min_checkins=5, k=4).collect()
    assert sorted((r["place"], r["brewery_name"], r["venue_city"], r["checkins"]) for r in view) == sorted(
        (("🏆 " if n <= 3 else "") + str(n), *e) for n, e in enumerate(expected[:4], 1)
    )
    shown = leaderboards.display(leaderboards.city_leaderboard_view(city_board, "Москва"), leaderboards.BREWERY_TITLES)
    assert shown.columns == ["МЕСТО", "НАЗВАНИЕ", "ГОРОД", "РЕЙТИНГ", "ИЗМЕНЕНИЕ", "ЧЕКИНОВ"]


def test_best_beers(reviews, beers, breweries):
    known = {b for b, _, style in BEERS if style}
    ranked = {}
    for name in ("now", "before"):
        board = means(((beer, b), s) for beer, b, _, s in window(name) if beer in known)
        ranked[name] = best_first(board)
    several = Counter(beer for beer, _ in ranked["before"])
    earlier = {beer: n for n, (beer, _) in enumerate(ranked["before"], 1) if several[beer] == 1}
    expected = [(*key, n, label(earlier.get(key[0]), n)) for n, key in enumerate(ranked["now"], 1)]
    totals = leaderboards.beer_totals(reviews, AS_OF)
    board = leaderboards.best_beers(totals, beers, breweries)
    got = [(r["beer_id"], r["brewery_id"], r["rank"], r["movement"]) for r in board.collect()]
    assert sorted(got) == sorted(expected)
    view = leaderboards.beers_view(board, min_checkins=3, k=4).collect()
    assert [r["place"] for r in view] == ["🏆 1", "🏆 2", "🏆 3", "4"]
    only = leaderboards.best_beers(totals, beers, breweries, styles=beers.filter("beer_style = 'style 1'"))
    assert {r["beer_name"] for r in only.collect()} <= {n for _, n, s in BEERS if s == "style 1"} | {"other name"}


def test_worst_beers_drop_ambiguous_and_unnamed(reviews, beers, breweries):
    board = means(((beer, b), s) for beer, b, _, s in window("now"))
    order = sorted(board, key=lambda k: (board[k][0] is None, board[k][0] or 0, k))
    several = Counter(beer for beer, _ in order)
    named = {b for b, _, _ in BEERS} - {500}  # 500 has two names
    expected = [(key[0], n) for n, key in enumerate(order, 1) if key[0] in named and several[key[0]] == 1]
    board = leaderboards.worst_beers(leaderboards.beer_totals(reviews, AS_OF), beers, breweries)
    got = [(r["beer_id"], r["rank"]) for r in board.collect()]
    assert sorted(got) == sorted(expected)


def test_top_venues(reviews, venues):
    home = {v for v, _, country in VENUES if country == "Россия"}

    def top(name):
        counts = Counter(v for _, _, v, _ in window(name) if v in home)
        return counts, sorted(counts, key=lambda v: (-counts[v], v))[:4]

    (now, ranks), (_, before) = top("now"), top("before")
    board = leaderboards.top_venues(reviews, venues, AS_OF, k=4).collect()
    assert [(r["venue_id"], r["checkins"], r["movement"]) for r in board] == [
        (v, now[v], label(before.index(v) + 1 if v in before else None, n)) for n, v in enumerate(ranks, 1)
    ]


def test_region_rating_counts_equal_ratings_once(reviews, venues):
    region = {v: v % 3 for v, _, _ in VENUES}
    triples = {(beer, v, s) for beer, _, v, s, _ in REVIEWS}
    expected = means((region.get(v), s) for _, v, s in triples)
    got = {r["region_id"]: r["beer_pure_avg"] for r in regions.region_rating(reviews, venues).collect()}
    assert got == {k: pytest.approx(m) for k, (m, _) in expected.items()}
    assert None in got
    kept = regions.region_rating(reviews, venues, drop_unmatched=True)
    assert None not in {r["region_id"] for r in kept.collect()}


def test_scatter(spark, reviews, breweries):
    info = spark.createDataFrame([(1, 365 * 5), (1, 9999), (2, 365 * 7)], "brewery_id bigint, stats_age_on_service int")
    expected = means((b, s) for _, b, _, s in window("now"))
    enough = {b: m for b, m in expected.items() if m[1] >= 10}
    best = scatter.brewery_scatter(reviews, breweries, info, AS_OF, top_n=6, min_count=10).collect()
    assert [r["brewery_id"] for r in best] == best_first(enough)[:6]
    worst = scatter.brewery_scatter(reviews, breweries, info, AS_OF, top_n=6, min_count=10, ascending=True).collect()
    assert [r["brewery_id"] for r in worst] == sorted(enough, key=lambda b: (enough[b][0], b))[:6]
    by_id = {r["brewery_id"]: r for r in [*best, *worst]}
    assert all(r["bucket_age"] == (1 if b == 1 else 2 if b == 2 else 0) for b, r in by_id.items())
    assert (by_id[12]["brewery_name"], by_id[12]["beer_count"]) == ("", 0) if 12 in by_id else True


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 3), st.one_of(st.none(), st.integers(0, 20))), min_size=1, max_size=30))
def test_share_sum_equals_mean(spark, ratings):
    rows = [(beer, brewery, None, None if s is None else s / 4, MIDNIGHT) for beer, brewery, s in ratings]
    df = spark.createDataFrame(rows, REVIEW_DDL)
    two_level = {r["brewery_id"]: r["brewery_pure_average"] for r in scatter.share_sum_means(df, AS_OF, 1).collect()}
    one_pass = {r["brewery_id"]: r["brewery_pure_average"] for r in scatter.brewery_means(df, AS_OF, 1).collect()}
    assert two_level == {k: v if v is None else pytest.approx(v) for k, v in one_pass.items()}


def test_price_panel(spark):
    quotes = spark.createDataFrame(
        [("Britain", 3.0, 2.0, "GBR", "2006-05-01"), ("Britain", 9.0, 1.0, "GBR", "2006-07-01"),
         ("Russia", 60.0, 30.0, "RUS", "2005-01-01"), ("Russia", 50.0, 0.0, "RUS", "2007-01-01"),
         ("Russia", 1.0, 1.0, "RUS", "2008-01-01"), ("Taiwan", 1.0, 1.0, "TWN", "2005-01-01")],
        "name string, local_price double, dollar_ex double, iso_a3 string, date string",
    ).withColumn("date", F.col("date").cast("date"))
    continents = spark.createDataFrame(
        [("Asia", "RUS"), ("Europe", "RUS"), ("Islands", "GBR")], "Continent_Name string, Three_Letter_Country_Code string"
    )
    wide = "`Country Name` string, `2005` double, `2006` double, `2007` double"
    population = spark.createDataFrame([("United Kingdom", 1.0, 2.0, None), ("Russian Federation", 5.0, 5.0, 0.0)], wide)
    gdp = spark.createDataFrame([("United Kingdom", 10.0, 30.0, 50.0)], wide)
    got = panel.price_panel(quotes, continents, population, gdp, 2005, 2007).orderBy("name", "year")
    assert [tuple(r) for r in got.collect()] == [
        ("Britain", 2005, "Islands", 0.0, 1.0, 10.0, 10.0),
        ("Britain", 2006, "Islands", 1.5, 2.0, 30.0, 15.0),
        ("Britain", 2007, "Islands", 0.0, 0.0, 50.0, 0.0),
        ("Russia", 2005, "Europe", 2.0, 5.0, 0.0, 0.0),
        ("Russia", 2006, "Europe", 0.0, 5.0, 0.0, 0.0),
        ("Russia", 2007, "Europe", 0.0, 0.0, 0.0, 0.0),
    ]
    frames = panel.motion_frames(got).filter("year = 2006").collect()
    assert {(r["continent"], tuple(r["text"]), tuple(r["size"])) for r in frames} == {
        ("Islands", ("Britain",), (30000000.0,)), ("Europe", ("Russia",), (0.0,)),
    }


def test_salaries(spark):
    cases = [
        ("$5,000 a month", "Brazil", 5000.0, 5000.0, "ok"),
        ("€30.000 - €60.000 pro Jahr", "Germany", 30000 / 12 * 1.2, 60000 / 12 * 1.2, "ok"),
        ("12.50 zł - 20 zł za godzinę", "Poland", None, None, "no_rate"),
        ("1000 VNĐ một tháng", "Vietnam", 1000 * 4e-5, 1000 * 4e-5, "no_index"),
        ("$ 100", "Brazil", None, None, "no_period"),
        ("R$ - R$ 300 por mês", "Brazil", None, 300 * 0.2, "ok"),
        ("a month", "Brazil", None, None, "bad_amount"),
        (None, "Brazil", None, None, "no_salary"),
    ]
    postings = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "n int, salary_text string, country string")
    rates = spark.createDataFrame(
        [("EUR", "2021-01-18", 1.2), ("BRL", "2021-01-18", 0.2), ("EUR", "2021-01-15", 9.0)],
        "currency string, rate_date string, usd double",
    ).withColumn("rate_date", F.col("rate_date").cast("date"))
    index = spark.createDataFrame([("Brazil", 4.0), ("Germany", 5.0), ("Poland", 3.0)], "country string, cost double")
    priced = vacancies.normalise_salaries(postings, rates, index, "2021-01-18").orderBy("n").collect()
    for row, (_, country, low, high, status) in zip(priced, cases):
        assert row["salary_status"] == status
        assert row["month_salary_from_USD"] == (low if low is None else pytest.approx(low))
        assert row["month_salary_to_USD"] == (high if high is None else pytest.approx(high))
        if status == "ok":
            cost = {"Brazil": 4.0, "Germany": 5.0}[country]
            assert row["year_salary_to_bigmac"] == pytest.approx(high / cost * 12)
            assert row["year_salary_to_USD"] == pytest.approx(high * 12)


def test_rejected_cards_do_not_hide_later_ones(spark):
    cards = spark.createDataFrame(
        [("Data analyst", "us", 0, "p_1", "Cook"), ("Data analyst", "us", 1, "p_1", "Data analyst"),
         ("Data analyst", "us", 2, "p_2", "Data analyst"), ("Data analyst", "us", 3, "p_2", "Data analyst")],
        "query_string string, country_code string, position bigint, element_id string, title string",
    )
    for name in vacancies.CARD_FIELDS:
        if name not in cards.columns:
            cards = cards.withColumn(name, F.lit(None).cast("string"))
    stored = spark.createDataFrame([(7, "9", "Data analyst")], "row_idx bigint, job_id string, query_string string")
    none = spark.createDataFrame([], "currency string, rate_date date, usd double")
    index = spark.createDataFrame([], "country string, cost double")
    rows = vacancies.vacancy_salaries(cards, stored, none, index, "2021-01-18").collect()
    assert sorted((r["row_idx"], r["job_id"], r["title"]) for r in rows) == [(8, "1", "Data analyst"), (9, "2", "Data analyst")]


def test_account_activity(spark):
    users = spark.createDataFrame([("a",), ("a",), ("b",), ("old",)], "user_name string")
    posts = spark.createDataFrame(
        [(f"p{i}", f"p{i}", "a", 10, i, 1000 + i, None if i else "it's") for i in range(120)]
        + [("q1", "q1", "old", 5, 5, 1, "x")],
        "code string, id string, owner string, likes_count bigint, comments_count bigint, date bigint, caption string",
    )
    comments = spark.createDataFrame([("c1", "p119", 'so "good"'), ("c2", "p3", "late")], "id string, post_id string, text string")
    stored_users = spark.createDataFrame([("old",)], "user_name string")
    stored_posts = spark.createDataFrame([("p118",)], "code string")
    got = accounts.account_activity(users, posts, comments, stored_users, stored_posts, "2021-01-18 10:00:00", 100)
    newest = [i for i in range(20, 120) if i != 118]
    assert sorted((r["user_name"], r["total_likes"], r["total_comments"]) for r in got.users.collect()) == [
        ("a", 10 * len(newest), sum(newest)), ("b", 0, 0),
    ]
    assert {r["code"] for r in got.posts.collect()} == {f"p{i}" for i in newest}
    assert [(r["id"], r["text"]) for r in got.comments.collect()] == [("c1", "so good")]
    whole = accounts.account_activity(users, posts, comments, stored_users, stored_posts, "2021-01-18 10:00:00")
    assert {r["code"] for r in whole.posts.collect()} == {f"p{i}" for i in range(120) if i != 118}


def test_catalogue(spark):
    pages = [
        ("a", '<span class="bold">Found\n</span><div class="average__number x">4,1</div><p class="text-micro">12 ratings</p>'
              '<span class="wine-price-value">1 234,5</span>'),
        ("b", '<span class="bold">Found</span><p class="text-micro">1,234 ratings</p>'),
        ("Shato", '<p>nothing</p><span class="purchaseAvailabilityPPC__amount--2_4GT">7.00€</span>'),
    ]
    offer = '<span class="purchaseAvailabilityPPC__amount--2_4GT">{}€</span>'
    offers = [("a", offer.format("3.00")), ("b", offer.format("9.75")), ("b", offer.format("9.75"))]
    frames = [spark.createDataFrame(rows, "vine string, html string") for rows in (pages, offers)]
    details = catalogue.product_details(*frames)
    assert sorted((r["vine"], r["find"], r["rating"], r["ratings_count"], r["avg_price"]) for r in details.collect()) == [
        ("Shato", None, None, None, None), ("a", "Found", 4.1, 12, 1234.5), ("b", "Found", None, 1234, 9.75),
    ]
    first = spark.createDataFrame([(1, "a\n", "0.7", "1"), (2, "b", "0.7", "2")], "row int, vine string, liter string, cost string")
    second = spark.createDataFrame([(1, "Шато", "1", "3"), (2, None, "1", "4")], "row int, vine string, liter string, cost string")
    one = catalogue.enriched(catalogue.clean_names(first), details)
    two = catalogue.enriched(catalogue.latin_names(second), details)
    assert [(r["name"], r["rating"], r["avg_price"]) for r in catalogue.single_finds(one).collect()] == [("a", "4,1", "1234,5")]
    assert sorted(r["name"] for r in catalogue.catalogue_summary(one, two).collect()) == ["Shato", "a", "b"]


def test_accounts_of_several_searches(spark):
    found = [spark.createDataFrame([(n, 1) for n in names], "user_name string, place int") for names in (["a", "b"], ["b", None], ["c"])]
    assert sorted(r[0] for r in accounts.found_accounts(*found).collect()) == ["a", "b", "c"]


def test_rows_after_the_first(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(20)] + [(None, 20)], "x int, id int")
    left = catalogue.after_first(df, [F.col("x").asc_nulls_last(), F.col("id").asc()], 10, ["id"])
    assert sorted(r["id"] for r in left.collect()) == sorted([10, 13, 16, 19] + list(range(2, 20, 3)) + [20])
    assert catalogue.after_first(df, [F.col("id").asc()], 50, ["id"]).count() == 0
