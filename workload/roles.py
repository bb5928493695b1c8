"""The given tables read in the roles the jobs expect. Everything here is a projection
or join of whole tables; derived values are plain functions of table columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barrelbook.plans.vacancies import country_name
from barrelbook.sources.readers import parse_records, read_table
from barrelbook.sources.schemas import FEED_RECORD

from . import derived as d


# The given tables, as they are stored.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


#: Rows that a task parses one by one.
DEALT_ROWS = 100_000


class Roles:
    """Tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet", SCHEMAS[name])

    def parts(self, name: str, rows: int = DEALT_ROWS) -> int:
        """Tasks for rows of a table that are parsed one by one: one for so many, and at least as many as
        ``spark.barrelbook.partitions``, or else the cluster's default, says."""
        least = self.spark.conf.get("spark.barrelbook.partitions", None) or self.spark.sparkContext.defaultParallelism
        return max(int(least), -(-self.table(name).count() // rows))

    def texts(self, name: str) -> DataFrame:
        """A table whose rows are parsed one by one. Its files may be few and hard to split, so its rows are
        dealt out first."""
        return self.table(name).repartition(self.parts(name))

    # Check-ins ---------------------------------------------------------------

    def ratings(self) -> DataFrame:
        """Check-ins without a venue: one line item is one rating of a beer."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("beer_id"),
            F.col("l_suppkey").alias("brewery_id"),
            F.col("l_quantity").alias("rating_score"),
            F.col("l_shipdate").alias("created_at"),
        )

    def reviews(self) -> DataFrame:
        """Check-ins with the venue, which is the customer of the order."""
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("venue_id")
        )
        return self.ratings().join(orders, "order_id").drop("order_id")

    def venues(self) -> DataFrame:
        """Customers as venues: the nation is city and region, the continent the country."""
        places = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return (
            self.table("customer")
            .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("venue_id"),
                F.col("c_name").alias("venue_name"),
                F.col("n_name").alias("venue_city"),
                F.col("r_name").alias("venue_country"),
                F.col("n_nationkey").alias("region_id"),
                F.col("n_name").alias("region_name"),
            )
        )

    def breweries(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("brewery_id"),
            F.col("s_name").alias("brewery_name"),
            ((F.col("s_suppkey") * 7) % 60).alias("beer_count"),
        )

    def brewery_info(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("brewery_id"),
            ((F.col("s_suppkey") * 37) % 4000).alias("stats_age_on_service"),
        )

    def beers(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("beer_id"),
            F.col("p_name").alias("beer_name"),
            F.col("p_type").alias("beer_style"),
        )

    # Country-year panel --------------------------------------------------------

    def _located_orders(self) -> DataFrame:
        return (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        )

    def _dealt_orders(self) -> DataFrame:
        """Dealt out after the joins, which have partitions of their own, and before long texts are made."""
        return self._located_orders().repartition(self.parts("orders"))

    def quotes(self) -> DataFrame:
        """Orders as price quotes of the customer's nation."""
        return self._located_orders().select(
            F.col("n_name").alias("name"),
            F.col("o_totalprice").alias("local_price"),
            (F.col("n_nationkey") % 7 + 1).cast("double").alias("dollar_ex"),
            F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso_a3"),
            F.col("o_orderdate").cast("date").alias("date"),
        )

    def continents(self) -> DataFrame:
        """One nation has no entry, two have a second one."""
        code = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
        nation = self.table("nation").withColumn("Three_Letter_Country_Code", code)
        listed = (
            nation.filter(F.col("n_name") != "NATION_7")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("r_name").alias("Continent_Name"), "Three_Letter_Country_Code")
        )
        twice = nation.filter(F.col("n_name").isin("NATION_3", "NATION_11")).select(
            F.lit("ANTARCTICA").alias("Continent_Name"), "Three_Letter_Country_Code"
        )
        return listed.unionByName(twice)

    def population(self, first: int, last: int) -> DataFrame:
        """Customers per nation, growing by year; one nation is spelled differently."""
        counted = (
            self.table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("people"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        )
        name = F.when(F.col("n_name") == "NATION_4", F.lit("Nation Four")).otherwise(F.col("n_name"))
        years = [(F.col("people") * (y - 1990)).cast("double").alias(str(y)) for y in range(first, last + 1)]
        return counted.select(name.alias("Country Name"), *years)

    def gdp(self, first: int, last: int) -> DataFrame:
        """Order value per nation and year, one column per year; one nation is absent."""
        years = [str(y) for y in range(first, last + 1)]
        return (
            self._located_orders()
            .filter(F.col("n_name") != "NATION_9")
            .withColumn("year", F.year("o_orderdate").cast("string"))
            .groupBy(F.col("n_name").alias("Country Name"))
            .pivot("year", years)
            .agg(F.sum(F.floor("o_totalprice").cast("bigint")).cast("double"))
        )

    # Vacancies -----------------------------------------------------------------

    def order_texts(self, **columns: str) -> DataFrame:
        """Order key, country and the given derived texts, one row per order."""
        derived = [F.expr(sql).alias(name) for name, sql in columns.items()]
        return self._dealt_orders().select(F.col("o_orderkey").alias("posting_id"), *derived)

    def rates(self) -> DataFrame:
        rows = [(c, date.fromisoformat(d.PRICING_DAY), usd) for c, usd in d.RATES.items()]
        rows += [(c, date.fromisoformat(d.OTHER_DAY), usd * 2) for c, usd in d.RATES.items()]
        return self.spark.createDataFrame(rows, "currency string, rate_date date, usd double")

    def price_index(self) -> DataFrame:
        """One price per country; one country has none."""
        return self.table("nation").filter(F.col("n_name") != "NATION_3").select(
            country_name(F.expr(d.COUNTRY_CODE)).alias("country"),
            (F.lit(2.0) + F.col("n_nationkey") / F.lit(4.0)).alias("cost"),
        )

    def feed(self) -> DataFrame:
        """Orders as JSON vacancy records, with missing parts."""
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        text_of = lambda column: column.cast("string")
        url = lambda kind, column: F.concat(F.lit(f"https://{kind}/"), text_of(column))
        station = F.struct(text_of(k % 50).alias("station_id"), F.col("n_name").alias("station_name"))
        address = F.struct(
            F.col("n_name").alias("city"),
            F.concat(F.lit("S"), text_of(c)).alias("street"),
            text_of(k % 90).alias("building"),
            F.lit(None).cast("string").alias("description"),
            ((k % 180) / 2.0).alias("lat"),
            ((c % 360) / 4.0).alias("lng"),
            F.concat(F.col("n_name"), F.lit(", S"), text_of(c)).alias("raw"),
            F.when(k % 2 == 0, F.array().cast("array<struct<station_id:string,station_name:string>>"))
            .otherwise(F.array(station))
            .alias("metro_stations"),
        )
        amount = F.expr(d.AMOUNT)
        salary = F.struct(
            F.when(k % 8 != 2, amount % 60000).alias("from"),
            amount.alias("to"),
            F.expr(d.pick("o_orderkey", d.texts("RUR", "USD", "EUR"))).alias("currency"),
            (k % 2 == 0).alias("gross"),
        )
        logos = F.create_map(
            F.lit("90"), url("l90", c), F.lit("240"), url("l240", c), F.lit("original"), url("l", c)
        )
        record = F.struct(
            text_of(k).alias("id"),
            F.expr(d.vacancy_name("o_orderkey")).alias("name"),
            (k % 2 == 0).alias("premium"),
            (k % 3 == 0).alias("has_test"),
            F.when(k % 4 != 0, url("r", k)).alias("response_url"),
            F.when(k % 5 != 0, address).alias("address"),
            url("v", k).alias("alternate_url"),
            url("apply", k).alias("apply_alternate_url"),
            F.when(
                k % 3 == 0, F.struct(text_of(k % 7).alias("id"), F.concat(F.lit("Dept "), text_of(k % 7)).alias("name"))
            ).alias("department"),
            F.when(k % 4 != 1, salary).alias("salary"),
            F.when(k % 11 == 0, F.struct(text_of(k).alias("id"), url("i", k).alias("url"))).alias("insider_interview"),
            F.struct(
                text_of(F.col("n_nationkey")).alias("id"),
                F.col("n_name").alias("name"),
                url("a", F.col("n_nationkey")).alias("url"),
            ).alias("area"),
            url("api", k).alias("url"),
            F.concat(
                F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"),
                F.lpad(text_of(k % 24), 2, "0"), F.lit(":15:00+0300"),
            ).alias("published_at"),
            F.struct(
                F.when(k % 13 != 0, text_of(c)).alias("id"),
                F.concat(F.lit('"'), F.col("c_name"), F.lit('"')).alias("name"),
                url("e", c).alias("url"),
                F.lit(None).cast("string").alias("alternate_url"),
                F.when(c % 2 == 0, logos).alias("logo_urls"),
            ).alias("employer"),
            (k % 5 == 1).alias("response_letter_required"),
            F.struct(F.lit("open").alias("id"), F.lit("Open").alias("name")).alias("type"),
            (k % 10 == 9).alias("archived"),
            F.when(
                k % 7 != 5, F.struct(F.expr(d.pick("o_orderkey", d.texts("fullDay", "remote", "flyInFlyOut", "shift"))).alias("id"))
            ).alias("schedule"),
        )
        return self._dealt_orders().select(
            F.lit("2021-01-18 10:00:00").alias("added_at"),
            F.expr(d.query("o_orderkey")).alias("query_string"),
            F.lit("Навык").alias("query_type"),
            F.lit(None).cast("string").alias("level"),
            F.lit("Analytics").alias("direction"),
            "o_orderstatus",
            "o_orderpriority",
            F.to_json(record).alias("body"),
        )

    def feed_records(self, feed: DataFrame | None = None) -> DataFrame:
        keep = ["added_at", "query_string", "query_type", "level", "direction"]
        return parse_records(self.feed() if feed is None else feed, "body", FEED_RECORD, keep)

    def repeated_feed(self) -> DataFrame:
        """The feed of two polls: urgent orders were returned twice."""
        feed = self.feed()
        return feed.unionByName(feed.filter(F.col("o_orderpriority") == "1-URGENT"))

    def stored_vacancies(self) -> DataFrame:
        """Finished orders are stored already."""
        return self.table("orders").filter(F.col("o_orderstatus") == "F").select(
            F.col("o_orderkey").cast("string").alias("vacancy_id"),
            F.expr(d.query("o_orderkey")).alias("query_string"),
        )

    def result_pages(self) -> DataFrame:
        """One result page with two cards per order; every eleventh page reports a bad query."""

        def card(j: int) -> Column:
            number = f"(o_orderkey * 2 + {j})"
            element = lambda tag, css, body: F.concat(
                F.lit(f'<{tag} class="{css}">'), body, F.lit(f"</{tag}>")
            )
            optional = lambda condition, part: F.when(F.expr(condition), part).otherwise(F.lit(""))
            href = F.concat(F.lit(' href="/rc/'), F.expr(d.text(number)), F.lit('"'))
            heading = F.concat(
                F.lit('<h2><a class="jobtitle turnstileLink"'), optional("o_orderkey % 9 <> 0", href), F.lit(">\n<b>"),
                F.replace(F.expr(d.title(number)), F.lit('"'), F.lit("&quot;")), F.lit("</b></a></h2>"),
            )
            salary, day = F.expr(d.salary(number)), F.expr(d.date_text(number))
            return F.concat(
                F.lit('<div class="jobsearch-SerpJobCard unifiedRow" id="p_'), F.expr(d.text(number)), F.lit('">'),
                heading,
                optional("o_orderkey % 7 <> 0", element("span", "company", F.concat(F.lit("\n"), F.col("c_name")))),
                optional("o_orderkey % 4 = 0", element("span", "ratingsContent", F.expr(d.text("o_orderkey % 5 + 0.5")))),
                element("div", "location accessible", F.col("n_name")),
                F.when(salary.isNotNull(), element("div", "x", element("span", "salaryText", salary))).otherwise(F.lit("")),
                element("div", "summary", F.replace(F.expr(d.summary(number)), F.lit("&"), F.lit("<br>&amp;"))),
                F.when(day.isNotNull(), element("span", "date", day)).otherwise(F.lit("")),
                optional(f"{j} = 1", element("span", "iaLabel", F.lit("Easily apply"))),
                optional("o_orderkey % 3 = 0", element("span", "remote", F.lit("Remote"))),
                F.lit("</div>"),
            )

        page = F.concat(
            F.lit('<!DOCTYPE html><html><body><div id="searchCountPages">'), F.expr(d.caption(d.COUNTRY_CODE)),
            F.lit("</div><td>"), card(0), card(1), F.lit("</td>"),
            F.when(F.col("o_orderkey") % 11 == 0, '<p class="notice bad_query">?</p>').otherwise(F.lit("<!-- bad_query -->")),
            F.lit("</body></html>"),
        )
        return self._dealt_orders().select(
            F.col("o_orderkey").alias("page_id"),
            F.expr(d.query("o_orderkey")).alias("query_string"),
            F.expr(d.COUNTRY_CODE).alias("country_code"),
            page.alias("html"),
        )

    def stored_postings(self) -> DataFrame:
        """First cards of finished orders are stored already."""
        return self.table("orders").filter(F.col("o_orderstatus") == "F").select(
            F.col("o_orderkey").alias("row_idx"),
            F.expr(d.text("o_orderkey * 2")).alias("job_id"),
            F.expr(d.query("o_orderkey")).alias("query_string"),
        )

    # Accounts ------------------------------------------------------------------

    def accounts(self) -> DataFrame:
        return self.table("conversations").select(
            F.concat(F.lit("user"), F.col("conv_id").cast("string")).alias("user_name"),
            (F.col("conv_id") % 2 == 0).alias("is_verified"),
        )

    def posts(self) -> DataFrame:
        code = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        said = self.table("conversations").filter(F.col("role") == "user")
        return said.select(
            F.concat(F.lit("user"), F.col("conv_id").cast("string")).alias("owner"),
            code.alias("id"),
            code.alias("code"),
            F.col("text").alias("caption"),
            F.col("turn").alias("comments_count"),
            F.length("text").cast("bigint").alias("likes_count"),
            (F.lit(1609459200) + F.col("turn") * 3600 + F.col("conv_id")).alias("date"),
            (F.col("turn") == 4).alias("is_video"),
        )

    def comments(self) -> DataFrame:
        answered = self.table("conversations").filter(F.col("role") == "assistant")
        return answered.select(
            F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
            F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("post_id"),
            F.col("role").alias("owner"),
            "text",
        )

    def stored_users(self) -> DataFrame:
        """Conversations with a system turn belong to stored accounts."""
        return self.table("conversations").filter(F.col("role") == "system").select(
            F.concat(F.lit("user"), F.col("conv_id").cast("string")).alias("user_name")
        )

    def stored_posts(self) -> DataFrame:
        return self.posts().filter(F.col("comments_count") == 2).select("code")

    # Catalogue -----------------------------------------------------------------

    def first_catalogue(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("row"),
            F.concat("p_name", F.lit(" \n"), "p_brand").alias("vine"),
            (F.col("p_size") / 4).cast("string").alias("liter"),
            F.col("p_retailprice").cast("string").alias("cost"),
        )

    def second_catalogue(self) -> DataFrame:
        cyrillic = F.translate(F.concat_ws(" ", "p_name", "p_brand"), d.LATIN, d.CYRILLIC)
        return self.table("part").select(
            F.col("p_partkey").alias("row"),
            F.when(F.col("p_partkey") % 10 != 0, cyrillic).alias("vine"),
            F.lit("0.75").alias("liter"),
            F.col("p_size").cast("string").alias("cost"),
        )

    def product_pages(self) -> DataFrame:
        """One result page per name and brand: with a price, or without; some show the offer of
        another product."""
        b = "CAST(substr(p_brand, 7) AS INT)"
        rating = F.expr(f"CASE WHEN {b} % 4 = 0 THEN '–' ELSE CAST({b} % 5 AS STRING) || ',' || CAST({b} % 10 AS STRING) END")
        count = F.expr(f"CASE WHEN {b} % 6 = 0 THEN '1,' || lpad(CAST({b} * 37 AS STRING), 3, '0') ELSE CAST({b} * 37 AS STRING) END")
        price = F.expr(
            f"CASE {b} % 3 WHEN 0 THEN '<span class=\"wine-price-value\">1 ' || CAST({b} AS STRING) || ',50\n</span>' "
            f"WHEN 1 THEN '' ELSE '<span class=\"purchaseAvailabilityPPC__amount--2_4GT\">9.99€</span>' END"
        )
        names = self.table("part").select("p_name", "p_brand").distinct()
        return names.select(
            F.concat_ws(" ", "p_name", "p_brand").alias("vine"),
            F.concat(
                F.lit('<html><body><div class="card"><span class="bold">'), F.col("p_name"), F.lit("\n</span>"),
                F.lit('<div class="text-inline-block light average__number">\n'), rating, F.lit("</div>"),
                F.lit('<p class="text-micro">'), count, F.lit(" ratings</p>"), price, F.lit("</div></body></html>"),
            ).alias("html"),
        )

    def offer_pages(self) -> DataFrame:
        """Product pages with an offer, for results with and without a price."""
        b = "CAST(substr(p_brand, 7) AS INT)"
        offer = F.expr(f"'<span class=\"purchaseAvailabilityPPC__amount--2_4GT\">' || CAST({b} AS STRING) || '.25€</span>'")
        names = self.table("part").select("p_name", "p_brand").distinct().filter(f"{b} % 3 <> 2")
        return names.select(
            F.concat_ws(" ", "p_name", "p_brand").alias("vine"),
            F.concat(F.lit("<html><body><h1>"), F.col("p_name"), F.lit("</h1>"), offer, F.lit("</body></html>")).alias("html"),
        )
