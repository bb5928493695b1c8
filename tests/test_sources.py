"""Readers, page extraction, sinks, stored results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from barrelbook.plans import refresh, vacancies
from barrelbook.session import scratch_path, shared_folder
from barrelbook.sources import html, readers, schemas, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv_with_doubled_quotes(spark, tmp_path):
    (tmp_path / "k.csv").write_text('Тип,Уровень,Направление,Ключевое слово\nНавык,,BI,"""Tableau"" OR ""BI, x"""\n')
    read = readers.read_csv(spark, str(tmp_path / "k.csv"), schemas.FEED_KEYWORDS)
    assert rows(read) == [("Навык", None, "BI", '"Tableau" OR "BI, x"')]


def test_csv_keeps_a_leading_blank_and_the_code_na(spark, tmp_path):
    (tmp_path / "j.csv").write_text('a,b,c,d\nen,Директор,NA, "Business Officer"\n')
    assert rows(readers.read_csv(spark, str(tmp_path / "j.csv"), schemas.POSTING_KEYWORDS)) == [
        ("en", "Директор", "NA", ' "Business Officer"')
    ]


def test_csv_without_header_and_with_line_breaks(spark, tmp_path):
    (tmp_path / "v.csv").write_text('"Rouge\n2015",0.75,"1,5"\nBlanc,1,2\n')
    read = readers.read_csv(spark, str(tmp_path / "v.csv"), schemas.CATALOGUE, header=False, multiline=True)
    assert rows(read) == [("Blanc", "1", "2"), ("Rouge\n2015", "0.75", "1,5")]


@pytest.mark.parametrize("block", [None, 64])
def test_csv_after_preamble_in_several_blocks(spark, tmp_path, block):
    """Only the head of a file is skipped, also if the file is read in many blocks."""
    for name in ("a", "b"):
        lines = ['"Data Source","x",', "", '"Updated",', '"Country Name","2005","2006"']
        lines += [f'"{name}{i}, the ""{i}""",{i},{"" if i % 2 else i * 2.5}' for i in range(200)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block * 16))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = readers.read_csv_after_preamble(spark, str(tmp_path), schemas.yearly(2005, 2006), 3)
        assert block is None or read.rdd.getNumPartitions() > 2
        expected = [(f'{n}{i}, the "{i}"', float(i), None if i % 2 else i * 2.5) for n in "ab" for i in range(200)]
        assert rows(read) == sorted(expected, key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_records(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id": "1", "salary": {"from": 5}}\n{"id": "2", "address": null}\n')
    read = readers.read_records(spark, str(tmp_path / "r.json"), schemas.FEED_RECORD)
    assert rows(read.select("record.id", "record.salary.from", "record.address.city")) == [("1", 5, None), ("2", None, None)]


PAGE = """<html><head><title> A &amp; B </title><style>div.card { }</style><script>"<div class='card'>"</script></head><body>
<!-- <div class="card">no</div> -->
<DIV class="big card" id='c_1'><a class="t" href="/1?a=1&amp;b=2">One <b>&lt;bold&gt;</b><br>tail</a><p>x<p>y
  <div class="inner">deep</div> after</div>
<div class="card" id=c_2><img class="t" src="i"><span class="inner card">two</span></div>
<div class="card"><a class="t">unclosed"""

FIELDS = {
    "id": (html.ITSELF, None, "id"),
    "title": ("a", "t", None),
    "href": ("a", "t", "href"),
    "inner": (None, "inner", None),
    "image": ("img", None, "src"),
}


def test_cards(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page int, html string")
    cards = html.extract_items(pages, "html", FIELDS, ["page"], ("div", "card"))
    assert rows(cards) == [
        (1, 0, "c_1", "One <bold>tail", "/1?a=1&b=2", "deep", None),
        (1, 1, "c_2", None, None, "two", "i"),
        (1, 2, None, "unclosed", None, None, None),
    ]


def test_cards_with_stray_signs_and_pages_without_items(spark):
    """Text keeps a "<" that opens no tag; a notice counts as a tag only, not in comments or texts."""
    card = '<div class="card"><a class="t" href="{0}">1 < 2 </ 3 <!-- no --> <B>{0}</b></a></div>'
    long = f'<div class="card" title="{"x" * 300}"><a class="t">y</a></div>'
    pages = spark.createDataFrame(
        [(1, card.format("a") * 2 + card.format("b") + long), (2, card.format("a") + '<p class="big none">'),
         (3, '<!-- <p class="none"> --> none ' + card.format("c"))],
        "page int, html string",
    )
    cards = html.extract_items(pages, "html", FIELDS, ["page"], ("div", "card"), unless="none")
    text = "1 < 2 </ 3  "
    assert rows(cards.select("page", "position", "title", "href")) == [
        (1, 0, text + "a", "a"), (1, 1, text + "a", "a"), (1, 2, text + "b", "b"), (1, 3, "y", None),
        (3, 0, text + "c", "c"),
    ]


def test_whole_page_as_one_item(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "plain")], "page int, html string")
    found = html.extract_items(pages, "html", {"bold": ("b", None, None)}, ["page"])
    assert rows(found) == [(1, 0, "<bold>"), (2, 0, None)]


def test_page_summaries(spark):
    pages = spark.createDataFrame(
        [(1, "us", '<p id="searchCountPages">no</p><div id="searchCountPages">\n Page 1 of 2,100 jobs</div>'),
         (2, "us", '<div class="bad_query">none</div>'), (3, "kr", '<div id="searchCountPages">12건</div>')],
        "page int, country_code string, html string",
    )
    assert rows(vacancies.page_summaries(pages, ["page"])) == [(1, 0, 2100), (2, 1, None), (3, 0, 12)]


def test_titles_and_links(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "no title")], "page int, html string")
    assert rows(pages.select("page", html.page_title(F.col("html")))) == [(1, "A & B"), (2, None)]
    assert rows(html.page_links(pages, "html", ["page"])) == [(1, 0, "/1?a=1&b=2", "One <bold>tail")]


def test_overwrite_by_keeps_every_row_of_a_hot_value(spark):
    path = scratch_path(spark, "cities")
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")[0:1]).alias("city"), "id")
    sinks.overwrite_by(df, path, ["city"])
    sinks.overwrite_by(df, path, ["city"])
    back = spark.read.schema("id bigint, city string").parquet(path)
    assert back.count() == 3000 and rows(back.select("city", "id")) == rows(df)


def test_csv_round_trip(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([('a "b", c', 1), ("↑ +2", None)], "s string, n int")
    sinks.overwrite_csv(df, path)
    assert rows(readers.read_csv(spark, path, "s string, n int")) == rows(df)


def test_ensure_table_is_repeatable(spark):
    path = scratch_path(spark, "table")
    for _ in range(2):
        sinks.ensure_table(spark, "kept", "n int", path)
        spark.createDataFrame([(1,)], "n int").write.insertInto("kept")
    assert spark.table("kept").count() == 2
    spark.sql("DROP TABLE kept")


def test_stored_or_computed(spark):
    compute = lambda days: spark.range(days)
    stored = lambda: spark.range(1)
    assert sinks.stored_or_computed({"days": 5}, {"days": 100}, stored, compute).count() == 5
    assert sinks.stored_or_computed({"days": 100}, {"days": 100}, stored, compute).count() == 1


def test_vacancy_export(spark):
    source, path = scratch_path(spark, "vacancies"), scratch_path(spark, "export")
    spark.createDataFrame([("1", None, None)], "id string, name string, pay int").write.parquet(source)
    refresh.export_vacancies(spark, source, path)
    assert [r[0] for r in spark.read.text(path).collect()] == ["id,name,pay", '1,"",']


def test_shared_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or spark.sparkContext.getCheckpointDir())
    assert spark.sparkContext.getCheckpointDir() is not None


def test_csv_keeps_values(spark, tmp_path):
    """Blanks, empty texts, NULL, quotes and line breaks come back as they were."""
    data = [(1, "  x "), (2, ""), (3, None), (4, 'say "hi", you'), (5, "two\nlines"), (6, " "), (7, "a\\b")]
    path = str(tmp_path / "csv")
    sinks.overwrite_csv(spark.createDataFrame(data, "id int, text string"), path)
    back = readers.read_csv(spark, path, "id int, text string", multiline=True)
    assert sorted((r.id, r.text) for r in back.collect()) == data
    frame = spark.createDataFrame([(i, t, i % 2) for i, t in data], "id int, text string, part int")
    sinks.overwrite_by(frame, path, ["part"], "csv")
    back = readers.read_csv(spark, path, "id int, text string, part int", multiline=True)
    assert sorted((r.id, r.text) for r in back.collect()) == data


def test_links_by_whole_attribute_names(spark):
    page = (
        """<a data-href="z" href="w">one</a><a title="x > y" HREF='two.html'>2</a><a href=three>3</a>"""
        """<a data-x=' href="no"' href="four">4</a><abbr href="no">5</abbr><a name="x">6</a>"""
    )
    pages = spark.createDataFrame([(1, page)], "page int, html string")
    found = [(r.href, r.text) for r in html.page_links(pages, "html", ["page"]).orderBy("position").collect()]
    assert found == [("w", "one"), ("two.html", "2"), ("three", "3"), ("four", "4")]


def test_bad_query_pages_have_no_cards(spark):
    from barrelbook.plans import vacancies

    card = '<div class="jobsearch-SerpJobCard" id="p_1"><a class="jobtitle">x</a></div>'
    rows_ = [(1, f'<div class="note bad_query">no</div>{card}'), (2, f"<p class='bad_query'>no</p>{card}"), (3, f"<p class=bad_query>{card}")]
    rows_ += [(4, f'<div class="not_bad_query">fine</div> bad_query {card}')]
    pages = spark.createDataFrame(rows_, "page int, html string")
    flags = pages.select("page", vacancies.reports_bad_query(F.col("html")).alias("bad"))
    assert [(r.page, r.bad) for r in flags.orderBy("page").collect()] == [(1, True), (2, True), (3, True), (4, False)]
    assert {r.page for r in vacancies.result_cards(pages, ["page"]).collect()} <= {4}


VALUES = [None, "", "plain", "a,b", 'said "so"', "two\nlines", "\n", '"', "\r\n dos", "end\n\n\n", " blank ", "é😀", '",\n"', "x" * 300]


def test_csv_with_line_breaks_in_many_tasks(spark):
    """One file cut in blocks at any place gives the records that one task reads."""
    pick = random.Random(8)
    rows = [(i, pick.choice(VALUES), pick.choice(VALUES)) for i in range(3000)]
    ddl, path = "id bigint, `first name` string, last string", scratch_path(spark, "csv")
    frame = spark.createDataFrame(rows, ddl)
    sinks.overwrite_csv(frame.coalesce(1), path)
    whole = spark.read.schema(ddl).options(header=True, multiLine=True, **readers._CSV).csv(path)
    expected = sorted(map(tuple, whole.collect()))
    assert expected == rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (1 << 12, 1 << 14, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            scan = spark.read.option("lineSep", "\n").text(path)
            assert (scan.rdd.getNumPartitions() > 20) == (size == 1 << 12)
            assert sorted(map(tuple, readers.read_csv(spark, path, ddl, multiline=True).collect())) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_with_line_breaks_without_header_and_in_several_files(spark):
    rows = [(i, VALUES[i % len(VALUES)]) for i in range(200)]
    path = scratch_path(spark, "csv")
    sinks.overwrite_csv(spark.createDataFrame(rows, "id bigint, text string").repartition(7), path, header=False)
    assert sorted(map(tuple, readers.read_csv(spark, path, "id bigint, text string", False, True).collect())) == rows
    empty = scratch_path(spark, "csv")
    sinks.overwrite_csv(spark.createDataFrame([], "id bigint, text string"), empty)
    assert readers.read_csv(spark, empty, "id bigint, text string", multiline=True).count() == 0


def test_links_in_comments_and_scripts_do_not_count(spark):
    page = '<!-- <a href="/c">c</a> --><SCRIPT>"<a href=/s>s</a>"</SCRIPT><a href="/x"><!-- y -->x</a><style>a{}</style><!-- <a href=/z>z</a>'
    found = html.page_links(spark.createDataFrame([(1, page)], "id int, html string"), "html", ["id"])
    assert [tuple(r) for r in found.collect()] == [(1, 0, "/x", "x")]


def test_pages_that_report_a_bad_query_have_no_cards(spark):
    card = '<div class="jobsearch-SerpJobCard" id="p_1"><a class="jobtitle">t</a></div>'
    notices = ["", '<p class="x bad_query">', "<!-- <p class=bad_query> -->", '<p class="bad_query2">', "<p class=bad_query>"]
    pages = spark.createDataFrame([(i, card + n) for i, n in enumerate(notices)], "id int, html string")
    assert sorted(r.id for r in vacancies.result_cards(pages, ["id"]).collect()) == [0, 2, 3]
