"""Registered queries: each reads whole tables below ``folder`` and returns a DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barrelbook import operators as ops
from barrelbook.functions import dates, numbers, rules, salary, text
from barrelbook.plans import accounts, catalogue, leaderboards, panel, refresh, regions, scatter, vacancies
from barrelbook.session import scratch_path
from barrelbook.operators import quantiles
from barrelbook.sources import html, published, readers, schemas, sinks
from barrelbook.streaming import ingest
from barrelbook.streaming.known_keys import KnownKeys

from . import derived as d
from .roles import SCHEMAS, Roles

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Parameters that fit the given tables.
AS_OF = "2001-06-30"
DAYS = 180
COUNTRY = "EUROPE"
WINDOWS = {"as_of": AS_OF, "days": DAYS, "previous_days": DAYS}
BOARD_CITIES = {"NATION_3": "NATION_8", "NATION_13": "Thirteen", "NATION_18": "Eighteen", "NATION_23": "Other"}
CITY_ALIASES = {"NATION_8": "NATION_3"}


def query(build: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
    REGISTRY[build.__name__] = lambda spark, folder: build(Roles(spark, folder))
    return build


# Leaderboards --------------------------------------------------------------------


@query
def brewery_leaderboard(t: Roles) -> DataFrame:
    return leaderboards.brewery_leaderboard(
        t.reviews(), t.venues(), t.breweries(), country=COUNTRY, min_checkins=5, k=25, **WINDOWS
    )


@query
def brewery_leaderboard_display(t: Roles) -> DataFrame:
    return leaderboards.display(brewery_leaderboard(t), leaderboards.BREWERY_TITLES)


@query
def brewery_leaderboard_prev(t: Roles) -> DataFrame:
    ranked = leaderboards.brewery_ranks(t.reviews(), t.venues(), country=COUNTRY, min_checkins=5, k=25, **WINDOWS)
    return ranked.filter(F.col("window") == "before").select("brewery_id", "mean", "checkins", "rank")


@query
def city_leaderboard(t: Roles) -> DataFrame:
    return leaderboards.city_leaderboard(
        t.reviews(), t.venues(), t.breweries(), country=COUNTRY, board_cities=BOARD_CITIES, **WINDOWS
    )


@query
def city_leaderboard_view(t: Roles) -> DataFrame:
    return leaderboards.city_leaderboard_view(city_leaderboard(t), min_checkins=2, k=10, aliases=CITY_ALIASES)


@query
def best_beers(t: Roles) -> DataFrame:
    return leaderboards.best_beers(leaderboards.beer_totals(t.ratings(), **WINDOWS), t.beers(), t.breweries())


@query
def best_beers_view(t: Roles) -> DataFrame:
    return leaderboards.beers_view(best_beers(t), min_checkins=2, k=10)


@query
def worst_beers(t: Roles) -> DataFrame:
    return leaderboards.worst_beers(leaderboards.beer_totals(t.ratings(), **WINDOWS), t.beers(), t.breweries())


@query
def worst_beers_view(t: Roles) -> DataFrame:
    return leaderboards.beers_view(worst_beers(t), min_checkins=1, k=10)


@query
def beer_styles(t: Roles) -> DataFrame:
    return leaderboards.beer_styles(t.beers())


@query
def top_venues(t: Roles) -> DataFrame:
    return leaderboards.top_venues(t.reviews(), t.venues(), country=COUNTRY, k=10, **WINDOWS)


# Scatter and map -----------------------------------------------------------------


@query
def brewery_scatter(t: Roles) -> DataFrame:
    return scatter.brewery_scatter(
        t.ratings(), t.breweries(), t.brewery_info(), AS_OF, DAYS, top_n=100, min_count=45
    )


@query
def brewery_scatter_worst(t: Roles) -> DataFrame:
    return scatter.brewery_scatter(
        t.ratings(), t.breweries(), t.brewery_info(), AS_OF, DAYS, top_n=20, min_count=45, ascending=True, label="short"
    )


@query
def scatter_medians(t: Roles) -> DataFrame:
    return scatter.scatter_medians(brewery_scatter(t))


@query
def scatter_with_medians(t: Roles) -> DataFrame:
    return scatter.with_medians(brewery_scatter(t)).select("brewery_id", "median_average", "median_count")


@query
def line_item_medians(t: Roles) -> DataFrame:
    """Exact medians of whole columns."""
    return quantiles.exact_medians(t.table("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"])


@query
def share_sum_mean(t: Roles) -> DataFrame:
    means = scatter.share_sum_means(t.ratings(), AS_OF, DAYS)
    return means.select("brewery_id", "rating_count", F.round("brewery_pure_average", 6).alias("brewery_pure_average"))


@query
def region_rating(t: Roles) -> DataFrame:
    rated = regions.region_rating(t.reviews(), t.venues(), step=1.0)  # whole points
    return rated.select(F.col("region_id").cast("bigint").alias("region_id"), "region_name", "beer_pure_avg")


# Country-year panel ----------------------------------------------------------------

FIRST_YEAR, LAST_YEAR = 1995, 2002


@query
def continent_lookup(t: Roles) -> DataFrame:
    yearly = panel.yearly_prices(t.quotes(), FIRST_YEAR, LAST_YEAR)
    return panel.with_continent(yearly, t.continents()).select("name", F.col("year").cast("bigint").alias("year"), "continent")


@query
def panel_densified(t: Roles) -> DataFrame:
    yearly = panel.yearly_prices(t.quotes(), FIRST_YEAR, LAST_YEAR).select("name", "year", "dollar_price")
    full = ops.densify(yearly, ["name"], "year", FIRST_YEAR, LAST_YEAR, {"dollar_price": 0.0})
    return full.withColumn("year", F.col("year").cast("bigint"))


@query
def missing_years(t: Roles) -> DataFrame:
    years = t.quotes().select("name", F.year("date").alias("year"))
    gaps = ops.missing_keys(years, ["name"], "year", 1990, LAST_YEAR)
    return gaps.withColumn("year", F.col("year").cast("bigint"))


@query
def wide_to_long_join(t: Roles) -> DataFrame:
    yearly = panel.yearly_prices(t.quotes(), FIRST_YEAR, LAST_YEAR).select("name", "year")
    wide = t.gdp(FIRST_YEAR, LAST_YEAR).withColumnRenamed("Country Name", "name")
    joined = ops.attach_years(yearly, wide, "name", range(FIRST_YEAR, LAST_YEAR + 1), "year", "gdp")
    return joined.withColumn("year", F.col("year").cast("bigint"))


def _panel(t: Roles) -> DataFrame:
    return panel.price_panel(
        t.quotes(),
        t.continents(),
        t.population(FIRST_YEAR, LAST_YEAR),
        t.gdp(FIRST_YEAR, LAST_YEAR),
        FIRST_YEAR,
        LAST_YEAR,
        excluded=["NATION_20"],
        aliases={"Nation Four": "NATION_4"},
    ).withColumn("year", F.col("year").cast("bigint"))


@query
def price_panel(t: Roles) -> DataFrame:
    return _panel(t)


@query
def motion_frames(t: Roles) -> DataFrame:
    frames = panel.motion_frames(_panel(t))
    points = F.arrays_zip("text", "x", "y", "size", "customdata")
    shown = frames.select("year", "continent", F.posexplode(points).alias("position", "point"))
    return shown.select(
        "year",
        "continent",
        F.col("position").cast("bigint").alias("position"),
        F.col("point.text").alias("text"),
        F.col("point.x").alias("x"),
        F.col("point.y").alias("y"),
        F.col("point.size").alias("size"),
        F.col("point.customdata").alias("customdata"),
    )


# Reusable steps ----------------------------------------------------------------------


@query
def any_left_join_lookup(t: Roles) -> DataFrame:
    customers = t.table("customer").select("c_custkey", "c_name")
    orders = t.table("orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderstatus"
    )
    joined = ops.any_left_join(
        customers, orders, "c_custkey", ["o_orderdate", "o_orderkey"], {"o_orderstatus": "none"}
    )
    return joined.select("c_custkey", "c_name", "o_orderkey", "o_orderstatus")


@query
def dict_lookup_default(t: Roles) -> DataFrame:
    orders = t.table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    names = t.table("customer").filter(F.col("c_acctbal") > 0).select("c_custkey", "c_name")
    return ops.dict_lookup(orders, names, "c_custkey", {"c_name": ""})


@query
def lookup_exactly_one(t: Roles) -> DataFrame:
    customers = t.table("customer").select("c_custkey")
    finished = t.table("orders").filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
    finished = finished.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return ops.lookup_exactly_one(customers, finished, "c_custkey", ["o_orderkey"], {"o_orderkey": -1})


@query
def anti_join_new_keys(t: Roles) -> DataFrame:
    events = t.table("events").select("event_id", "user_id", "event_type", "value")
    stored = events.filter(F.col("value") > 250).select("user_id", "event_type")
    return ops.new_rows(events, stored, ["user_id", "event_type"], ["event_id"])


@query
def semi_join_styles(t: Roles) -> DataFrame:
    rated = t.ratings().filter(F.col("rating_score") >= 50).select("beer_id")
    return ops.semi_join(t.beers(), rated, "beer_id")


@query
def alias_normalisation(t: Roles) -> DataFrame:
    nations = t.table("nation").select("n_name", F.col("n_regionkey").cast("bigint").alias("n_regionkey"))
    renamed = ops.alias_names(nations, "n_name", {"NATION_1": "ONE", "NATION_11": "ONE"})
    customers = t.table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    named = t.table("nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"))
    totals = ops.alias_names(named, "n_name", {"NATION_1": "ONE", "NATION_11": "ONE"})
    return totals.groupBy("n_name").agg(F.sum("customers").alias("customers")).join(
        renamed.groupBy("n_name").agg(F.count(F.lit(1)).alias("spellings")), "n_name"
    )


@query
def dedup_keep_first(t: Roles) -> DataFrame:
    events = t.table("events").select("user_id", "event_type", "event_id", "value")
    return ops.keep_first(events, ["user_id", "event_type"], [F.col("value").desc(), "event_id"])


@query
def dedup_drop_all(t: Roles) -> DataFrame:
    orders = t.table("orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return ops.drop_repeated_keys(orders, ["o_custkey", "o_orderpriority"])


@query
def latest_by_key(t: Roles) -> DataFrame:
    events = t.table("events").select("user_id", "event_id", "event_type", "props")
    return ops.latest_by_key(events, ["user_id"], "event_id")


@query
def row_ids_after_max(t: Roles) -> DataFrame:
    orders = t.table("orders").select(F.col("o_orderkey").alias("row_idx"), "o_totalprice", "o_orderstatus")
    stored = orders.filter(F.col("o_orderstatus") == "F")
    batch = orders.filter(F.col("o_orderstatus") != "F").select(F.col("row_idx").alias("o_orderkey"), "o_totalprice")
    return ops.number_rows_after(stored, batch, [F.col("o_totalprice").asc(), F.col("o_orderkey").asc()])


@query
def rows_after_offset(t: Roles) -> DataFrame:
    parts = t.table("part").select("p_partkey", "p_name", "p_size")
    order = [F.col("p_size").desc(), F.col("p_partkey").asc()]
    return catalogue.after_first(parts, order, 30, ["p_partkey"]).select(
        "p_partkey", "p_name"
    )


@query
def union_by_name(t: Roles) -> DataFrame:
    customers = t.table("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    suppliers = t.table("supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return customers.unionByName(suppliers)


# Rules and salary texts ----------------------------------------------------------------


@query
def name_exclusion(t: Roles) -> DataFrame:
    names = t.order_texts(name=d.vacancy_name("o_orderkey"))
    name = text.strip_quotes(F.col("name"))
    return names.select("posting_id", name.alias("name"), rules.excluded_name(name).alias("excluded"))


@query
def title_rules(t: Roles) -> DataFrame:
    titles = t.order_texts(query=d.query("o_orderkey"), title=d.title("o_orderkey"))
    return titles.select(
        "posting_id",
        "title",
        rules.has_title_rules(F.col("query")).alias("has_rules"),
        rules.title_matches(F.col("title"), F.col("query")).alias("accepted"),
    )


@query
def skill_tags(t: Roles) -> DataFrame:
    return t.texts("documents").select("doc_id", text.skill_tags(F.col("text")).alias("skills"))


@query
def currency_detect(t: Roles) -> DataFrame:
    return t.texts("documents").select("doc_id", salary.currency_of(F.col("text")).alias("currency"))


@query
def period_detect(t: Roles) -> DataFrame:
    texts = t.order_texts(salary_text=d.salary("o_orderkey"))
    split = salary.split_period(F.col("salary_text"))
    return texts.select("posting_id", split["period"].alias("period"), split["text"].alias("rest"))


@query
def salary_range(t: Roles) -> DataFrame:
    texts = t.order_texts(salary_text=d.salary("o_orderkey"))
    parsed = vacancies.parse_salaries(texts)
    return parsed.select("posting_id", F.col("salary_currency").alias("currency"), "salary_from", "salary_to")


def _salaries(t: Roles) -> DataFrame:
    postings = t.order_texts(salary_text=d.salary("o_orderkey"), code=d.COUNTRY_CODE)
    located = postings.withColumn("country", vacancies.country_name(F.col("code")))
    return vacancies.normalise_salaries(located, t.rates(), t.price_index(), d.PRICING_DAY)


@query
def salary_month_usd(t: Roles) -> DataFrame:
    priced = _salaries(t)
    amounts = [f"{span}_salary_{side}_USD" for span in ("month", "year") for side in ("from", "to")]
    return priced.select("posting_id", "salary_status", *amounts)


@query
def salary_index_units(t: Roles) -> DataFrame:
    priced = _salaries(t)
    amounts = [f"{span}_salary_{side}_bigmac" for span in ("month", "year") for side in ("from", "to")]
    return priced.select("posting_id", "country", *amounts)


@query
def relative_dates(t: Roles) -> DataFrame:
    texts = t.order_texts(date_text=d.date_text("o_orderkey"))
    day = dates.relative_date(F.col("date_text"), d.PRICING_DAY)
    return texts.select("posting_id", day.cast("string").alias("day"))


@query
def sheet_names(t: Roles) -> DataFrame:
    return t.table("orders").select("o_orderkey", dates.quarter_sheet(F.col("o_orderdate")).alias("sheet"))


@query
def result_counts(t: Roles) -> DataFrame:
    captions = t.order_texts(code=d.COUNTRY_CODE, caption=d.caption(d.COUNTRY_CODE))
    return captions.select("posting_id", dates.result_count(F.col("caption"), F.col("code")).alias("results"))


@query
def keywords_by_country(t: Roles) -> DataFrame:
    terms = t.table("part").select(
        F.when(F.col("p_size") % 2 == 0, "ru").otherwise("en").alias("language"), F.col("p_name").alias("query")
    ).distinct()
    places = t.table("nation").select(
        F.when(F.col("n_nationkey") == 4, "ru").otherwise(F.expr(d.COUNTRY_CODE)).alias("country_code")
    )
    return vacancies.keywords_by_country(terms, places).select("country_code", "language", "query")


# Feeds -----------------------------------------------------------------------------------


@query
def vacancy_feed_flatten(t: Roles) -> DataFrame:
    flat = vacancies.flatten_feed(t.feed_records())
    return flat.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query
def vacancy_feed_filters(t: Roles) -> DataFrame:
    records = t.feed_records()
    return records.select(F.col("record.id").alias("vacancy_id"), vacancies.feed_accepts(F.col("record")).alias("accepted"))


@query
def vacancy_feed(t: Roles) -> DataFrame:
    fresh = vacancies.vacancy_feed(t.feed_records(t.repeated_feed()), t.stored_vacancies())
    return fresh.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query
def vacancy_salaries(t: Roles) -> DataFrame:
    cards = vacancies.result_cards(t.result_pages(), ["query_string", "country_code"])
    rows = vacancies.vacancy_salaries(cards, t.stored_postings(), t.rates(), t.price_index(), d.PRICING_DAY)
    return rows.withColumns({c: F.col(c).cast("string") for c in ("job_added", "added_date")})


@query
def html_cards(t: Roles) -> DataFrame:
    return vacancies.result_cards(t.result_pages(), ["page_id"])


@query
def page_summaries(t: Roles) -> DataFrame:
    return vacancies.page_summaries(t.result_pages(), ["page_id"])


# Accounts and catalogue --------------------------------------------------------------------


@query
def accounts_by_query(t: Roles) -> DataFrame:
    """Accounts found by one search per role, merged into one list."""
    said = t.table("conversations").withColumn("user_name", F.concat(F.lit("user"), F.col("conv_id").cast("string")))
    return accounts.found_accounts(*[said.filter(F.col("role") == role) for role in ("user", "assistant", "system")])


def _activity(t: Roles) -> accounts.Activity:
    return accounts.account_activity(
        t.accounts(), t.posts(), t.comments(), t.stored_users(), t.stored_posts(), "2021-01-18 10:00:00"
    )


@query
def account_activity(t: Roles) -> DataFrame:
    return _activity(t).users.drop("added_at")


@query
def account_posts(t: Roles) -> DataFrame:
    posts = _activity(t).posts.drop("added_at")
    return posts.withColumn("date", F.unix_seconds("date"))


@query
def account_comments(t: Roles) -> DataFrame:
    return _activity(t).comments.drop("added_at")


def _catalogues(t: Roles) -> tuple[DataFrame, DataFrame]:
    details = catalogue.product_details(t.product_pages(), t.offer_pages())
    first = catalogue.enriched(catalogue.clean_names(t.first_catalogue()), details)
    second = catalogue.enriched(catalogue.latin_names(t.second_catalogue()), details)
    return first, second


@query
def catalogue_enrichment(t: Roles) -> DataFrame:
    return catalogue.single_finds(_catalogues(t)[0])


@query
def catalogue_summary(t: Roles) -> DataFrame:
    return catalogue.catalogue_summary(*_catalogues(t))


@query
def transliterate(t: Roles) -> DataFrame:
    names = t.second_catalogue().dropna(subset=["vine"])
    spelled = F.concat("vine", F.lit(" Жук цапля чаща шило щука юла Яблоко объезд"))
    return names.select("row", text.transliterate(spelled).alias("vine"))


@query
def decimal_comma(t: Roles) -> DataFrame:
    prices = t.table("part").select(
        "p_partkey", F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")).alias("price")
    )
    value = numbers.parse_decimal_comma(F.col("price"))
    return prices.select("p_partkey", value.alias("value"), numbers.format_decimal_comma(value + 1).alias("next"))


# Pages ---------------------------------------------------------------------------------------


@query
def html_titles(t: Roles) -> DataFrame:
    return t.texts("pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query
def html_links(t: Roles) -> DataFrame:
    hidden = F.lit('<!-- <a href="/hidden">h</a> --><script>"<a href=/no>x</a>"</script>')
    return html.page_links(t.texts("pages").withColumn("html", F.concat(hidden, "html")), "html", ["page_id"])


@query
def html_menu_items(t: Roles) -> DataFrame:
    fields = {"href": ("a", None, "href"), "text": ("a", None, None)}
    return html.extract_items(t.texts("pages"), "html", fields, ["page_id"], ("li", None))


# Files, tables and stored results -----------------------------------------------------------


def _scratch(t: Roles, label: str) -> str:
    return scratch_path(t.spark, label)


@query
def csv_with_header(t: Roles) -> DataFrame:
    path = _scratch(t, "customers")
    sinks.overwrite_csv(t.table("customer").withColumn("c_name", F.concat(F.lit('"N", '), "c_name")), path)
    return readers.read_csv(t.spark, path, SCHEMAS["customer"])


@query
def csv_headerless(t: Roles) -> DataFrame:
    path = _scratch(t, "parts")
    sinks.overwrite_csv(t.table("part"), path, header=False)
    return readers.read_csv(t.spark, path, SCHEMAS["part"], header=False)


@query
def csv_after_preamble(t: Roles) -> DataFrame:
    path, wide = _scratch(t, "gdp"), t.gdp(FIRST_YEAR, LAST_YEAR)
    notes = ['"Data Source","Indicators",', ",", '"Last Updated",', ",".join(f'"{c}"' for c in wide.columns)]
    head = t.spark.createDataFrame(list(enumerate(notes)), "n int, value string")
    body = wide.select(F.lit(len(notes)).alias("n"), F.to_csv(F.struct(*[f"`{c}`" for c in wide.columns])).alias("value"))
    file = head.unionByName(body).coalesce(1).sortWithinPartitions("n")
    file.select("value").write.text(path)
    read = readers.read_csv_after_preamble(t.spark, path, schemas.yearly(FIRST_YEAR, LAST_YEAR), 3)
    years = [F.col(f"`{y}`").alias(f"y{y}") for y in range(FIRST_YEAR, LAST_YEAR + 1)]
    return read.select(F.col("Country Name").alias("name"), *years)


@query
def table_export(t: Roles) -> DataFrame:
    path = _scratch(t, "export")
    sinks.export_table(t.spark, "orders", path, lambda _, name: t.table(name))
    back = readers.read_csv(t.spark, path, SCHEMAS["orders"])
    return back.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query
def vacancy_export_view(t: Roles) -> DataFrame:
    shown = vacancies.export_view(vacancies.flatten_feed(t.feed_records()))
    return shown.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query
def vacancy_export_job(t: Roles) -> DataFrame:
    """The stored feed written as text and read back."""
    table, path = _scratch(t, "vacancies"), _scratch(t, "export")
    vacancies.flatten_feed(t.feed_records()).write.parquet(table)
    written = refresh.export_vacancies(t.spark, table, path)
    back = readers.read_csv(t.spark, path, written.schema, multiline=True)
    return back.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query
def feed_from_files(t: Roles) -> DataFrame:
    path = _scratch(t, "feed")
    t.feed().select("body").write.text(path)
    record = readers.read_records(t.spark, path, schemas.FEED_RECORD)
    found = ["added_at", "query_string", "query_type", "level", "direction"]
    flat = vacancies.flatten_feed(record.select("record", *[F.lit("").alias(c) for c in found])).drop(*found)
    return flat.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query
def append_sink(t: Roles) -> DataFrame:
    path, orders = _scratch(t, "orders"), t.table("orders")
    sinks.append_rows(orders.filter("o_orderstatus = 'F'"), path)
    sinks.append_rows(orders.filter("o_orderstatus <> 'F'"), path)
    stored = readers.read_table(t.spark, path)
    return stored.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query
def created_table_latest(t: Roles) -> DataFrame:
    """Two versions of every event in a table created on demand; the later one counts."""
    path = _scratch(t, "events")
    name, ddl = f"events_{path[-32:]}", "row_idx bigint, version int, value double"
    for version, factor in ((1, 1), (2, 2)):
        sinks.ensure_table(t.spark, name, ddl, path)
        rows = t.table("events").select(
            F.col("event_id").alias("row_idx"), F.lit(version).alias("version"), (F.col("value") * factor).alias("value")
        )
        rows.write.insertInto(name)
    t.spark.sql(f"DROP TABLE {name}")  # its files stay
    return ops.latest_by_key(readers.read_table(t.spark, path, ddl), ["row_idx"], "version")


@query
def partitioned_by_city(t: Roles) -> DataFrame:
    path = _scratch(t, "cities")
    board = city_leaderboard(t)
    sinks.overwrite_by(board, path, ["board_city"])
    return t.spark.read.schema(board.schema).parquet(path)


@query
def stored_or_computed(t: Roles) -> DataFrame:
    path, parameters = _scratch(t, "scatter"), {"top_n": 100, "min_count": 45}

    def compute(top_n: int, min_count: int) -> DataFrame:
        return scatter.brewery_scatter(
            t.ratings(), t.breweries(), t.brewery_info(), AS_OF, DAYS, top_n=top_n, min_count=min_count
        )

    compute(**parameters).write.parquet(path)
    results = [
        sinks.stored_or_computed(parameters, stored_for, lambda: readers.read_table(t.spark, path), compute).withColumn(
            "source", F.lit(source)
        )
        for source, stored_for in (("stored", parameters), ("computed", {**parameters, "top_n": 1}))
    ]
    return results[0].unionByName(results[1])


@query
def catalogued_results(t: Roles) -> DataFrame:
    """A result asked for four times: computed, found, computed for other parameters, and computed again
    after the check-ins have changed."""
    root, source = _scratch(t, "results"), _scratch(t, "ratings")
    t.ratings().filter("brewery_id % 2 = 0").write.parquet(source)

    def compute(top_n: int) -> DataFrame:
        ratings = readers.read_table(t.spark, source)
        return scatter.brewery_scatter(ratings, t.breweries(), t.brewery_info(), AS_OF, DAYS, top_n=top_n, min_count=45)

    def ask(step: int, top_n: int) -> DataFrame:
        inputs = published.input_version(readers.read_table(t.spark, source))
        found, status = published.result_for(t.spark, root, {"top_n": top_n}, inputs, compute)
        return found.select(F.lit(step).alias("step"), F.lit(status).alias("status"), "brewery_id", "rating_count")

    answers = [ask(0, 100), ask(1, 100), ask(2, 20)]
    t.ratings().filter("brewery_id % 2 = 1").write.mode("append").parquet(source)
    return functools.reduce(DataFrame.unionByName, [*answers, ask(3, 100)])


_REFRESH = {
    "country": COUNTRY, "days": DAYS, "board_cities": BOARD_CITIES, "scatter_days": DAYS, "scatter_top": 100,
    "scatter_min_count": 45,
}


def _published(t: Roles, root: str) -> DataFrame:
    names = published.current_version(t.spark, root).names
    stored = [published.read_published(t.spark, root, name).withColumn("name", F.lit(name)) for name in names]
    return functools.reduce(functools.partial(DataFrame.unionByName, allowMissingColumns=True), stored)


@query
def daily_refresh(t: Roles) -> DataFrame:
    root = _scratch(t, "refresh")
    refresh.refresh(t.reviews(), t.venues(), t.breweries(), t.brewery_info(), t.beers(), AS_OF, root, **_REFRESH)
    return _published(t, root)


@query
def incremental_refresh(t: Roles) -> DataFrame:
    """The refresh of a day after that of the day before: it is given the check-ins of its day alone."""
    root = _scratch(t, "refresh")
    tables = (t.venues(), t.breweries(), t.brewery_info(), t.beers())
    day_before = date.fromisoformat(AS_OF) - timedelta(days=1)
    refresh.store_checkin_days(t.reviews(), root, day_before - timedelta(days=2 * DAYS), day_before)
    refresh.refresh_from_days(t.spark, *tables, day_before, root, **_REFRESH)
    refresh.store_checkin_days(t.reviews().filter(F.to_date("created_at") == AS_OF), root, AS_OF)
    refresh.refresh_from_days(t.spark, *tables, AS_OF, root, **_REFRESH)
    return _published(t, root)


# Streams --------------------------------------------------------------------------------------

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def _events_twice(t: Roles) -> DataFrame:
    """The events as a stream in which every row arrives twice."""
    read = lambda: ingest.read_feed(t.spark, t.folder, EVENTS, "parquet", pathGlobFilter="events.parquet")
    return read().union(read())


@query
def stream_ingest_dedup(t: Roles) -> DataFrame:
    target, checkpoint = _scratch(t, "target"), _scratch(t, "checkpoint")
    keys = ["user_id", "event_type"]
    events = _events_twice(t).withColumn("user_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))
    ingest.store_new_rows(events, target, checkpoint, keys, ["event_id"]).awaitTermination()
    return ingest.known_rows(t.spark, target, EVENTS).select("event_id", *keys, "value")


@query
def stream_two_feeds(t: Roles) -> DataFrame:
    """Two feeds with some rows in common, each with a checkpoint of its own, into one target."""
    target = _scratch(t, "target")
    for absent in (0, 1):
        feed = _events_twice(t).filter(F.col("event_id") % 3 != absent)
        ingest.store_new_rows(feed, target, _scratch(t, "checkpoint"), ["event_id"]).awaitTermination()
    return ingest.known_rows(t.spark, target, EVENTS).drop(ingest.BATCH)


@query
def stream_known_keys(t: Roles) -> DataFrame:
    target, checkpoint = _scratch(t, "target"), _scratch(t, "checkpoint")
    keys = ["user_id", "event_type"]
    ingest.append_stream(ingest.remember_keys(_events_twice(t).select(*keys), keys), target, checkpoint).awaitTermination()
    return t.spark.read.schema("user_id bigint, event_type string").parquet(target)


def _event_files(t: Roles, parts: list[Column]) -> str:
    """The events as files, one per condition, in this order."""
    source = _scratch(t, "source")
    events = t.spark.read.schema(EVENTS).parquet(f"{t.folder}/events.parquet")
    for part in parts:
        events.filter(part).coalesce(1).write.mode("append").parquet(source)
    return source


def _newest_first(t: Roles, files: int) -> DataFrame:
    """Files that arrive newest first, one per batch, every row twice: all but the first file's are late."""
    events = t.spark.read.schema(EVENTS).parquet(f"{t.folder}/events.parquet")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    parts = []
    for part in reversed(range(files)):
        inside = F.col("ts") >= first + (last - first) * part / files
        if part < files - 1:
            inside &= F.col("ts") < first + (last - first) * (part + 1) / files
        parts.append(inside)
    feed = ingest.read_feed(t.spark, _event_files(t, parts), EVENTS, "parquet", maxFilesPerTrigger="1")
    return feed.union(feed)


@query
def stream_bounded_dedup(t: Roles) -> DataFrame:
    """Files that arrive newest first: every row but the first file's is late."""
    target, checkpoint = _scratch(t, "target"), _scratch(t, "checkpoint")
    ingest.store_recent_rows(_newest_first(t, 4), target, checkpoint, ["event_id"], "ts", "1 hour").awaitTermination()
    return ingest.known_rows(t.spark, target, EVENTS).drop(ingest.BATCH)


@query
def stream_bounded_state(t: Roles) -> DataFrame:
    """The same with a memory that forgets: late rows are checked against the target."""
    target, checkpoint = _scratch(t, "target"), _scratch(t, "checkpoint")
    known = KnownKeys(_scratch(t, "known"), ["event_id"], 8, "ts")
    feed = _newest_first(t, 6)
    ingest.store_bounded_rows(feed, target, checkpoint, known, timedelta(hours=1), compact_every=2).awaitTermination()
    return ingest.known_rows(t.spark, target, EVENTS).drop(ingest.BATCH)


@query
def stream_bucketed_keys(t: Roles) -> DataFrame:
    """Every event arrives in two files; known keys lie in buckets that are merged on the way."""
    target, checkpoint = _scratch(t, "target"), _scratch(t, "checkpoint")
    parts = [F.pmod("event_id", F.lit(4)).isin(part, (part + 1) % 4) for part in range(4)]
    feed = ingest.read_feed(t.spark, _event_files(t, parts), EVENTS, "parquet", maxFilesPerTrigger="1")
    known = KnownKeys(_scratch(t, "known"), ["event_id", "event_type"], 8)
    ingest.store_new_rows(feed, target, checkpoint, known.keys, known=known, compact_every=3).awaitTermination()
    return ingest.known_rows(t.spark, target, EVENTS).drop(ingest.BATCH)


def _feed_files(t: Roles) -> int:
    """Files of a feed made of the orders, read in two batches: four, and more for larger tables, so that
    neither a file nor a bucket of known keys grows with them."""
    return max(4, 2 * (-(-t.table("orders").count() // 100_000)))


@query
def stream_vacancy_feed(t: Roles) -> DataFrame:
    """The vacancy feed as files that arrive in several batches, with repeated records."""
    source, target, checkpoint = (_scratch(t, label) for label in ("source", "target", "checkpoint"))
    columns = ["added_at", "query_string", "query_type", "level", "direction", "body"]
    files = _feed_files(t)
    t.repeated_feed().select(*columns).repartition(files).write.parquet(source)
    feed = ingest.read_feed(
        t.spark, source, ", ".join(f"{c} string" for c in columns), "parquet", maxFilesPerTrigger=str(files // 2)
    )

    def accepted(batch: DataFrame) -> DataFrame:
        return vacancies.flatten_feed(vacancies.accepted_records(t.feed_records(batch)))

    flat = ", ".join(f"{c} {kind}" for c, kind in accepted(t.feed()).dtypes)
    known = KnownKeys(_scratch(t, "known"), vacancies.FEED_KEYS, max(8, files))
    run = ingest.store_new_rows(feed, target, checkpoint, known.keys, ["published_at"], accepted, flat, known)
    run.awaitTermination()
    stored = ingest.known_rows(t.spark, target, flat).drop(ingest.BATCH)
    return stored.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query
def stream_postings(t: Roles) -> DataFrame:
    """Result pages that arrive as files: accepted postings, each (job, query) once."""
    source, target, checkpoint = (_scratch(t, label) for label in ("source", "target", "checkpoint"))
    pages = t.result_pages().select("query_string", "country_code", "html")
    files = _feed_files(t)
    pages.repartition(files).write.parquet(source)
    schema = "query_string string, country_code string, html string"
    feed = ingest.read_feed(t.spark, source, schema, "parquet", maxFilesPerTrigger=str(files // 2))

    def postings(batch: DataFrame) -> DataFrame:
        cards = vacancies.result_cards(batch, ["query_string", "country_code"])
        return vacancies.posting_rows(vacancies.accepted_cards(cards), t.rates(), t.price_index(), d.PRICING_DAY)

    stored = ", ".join(f"{c} {kind}" for c, kind in postings(t.result_pages()).dtypes)
    known = KnownKeys(_scratch(t, "known"), vacancies.POSTING_KEYS, max(8, files))
    run = ingest.store_new_rows(feed, target, checkpoint, known.keys, [], postings, stored, known)
    run.awaitTermination()
    rows = ingest.known_rows(t.spark, target, stored).drop(ingest.BATCH)
    return rows.withColumns({c: F.col(c).cast("string") for c in ("job_added", "added_date")})
