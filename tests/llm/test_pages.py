from __future__ import annotations

import functools
import html
import os
import random
import re
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barrelbook.llm import pages

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def lines(page):
    return [t for t, _ in pages.text_lines(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("plain  text\n here", ["plain text here"]),
        ("<p>a<p>b<br>c<div>d</div>e", ["a", "b c", "d", "e"]),
        ("<p>x &amp;amp; &lt;b&gt; &#233;&eacute;&nbsp;y</p>", ["x &amp; <b> éé y"]),
        ("<script>var t='</p>';</script><p>a</p><style>p{}</style>", ["a"]),
        ("<script>never closed <p>a</p>", []),
        ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no</p>", ["yes"]),
        ("<nav><ul><li>menu</ul><article><p>text", ["text"]),
        ("<div class='ad x'><div>no</div>no</div><p>yes</p>", ["yes"]),
        ("<div class='add shadow'>yes</div>", ["yes"]),
        ("<div id=comments><p>no</p></div><div role=banner>no</div><p hidden>no</p><p>1 < 2 <3</p>", ["1 < 2 <3"]),
        ("<header>site</header><article><header><h1>Title</h1></header><p>a</p><footer>no</footer></article>", ["Title", "a"]),
        ("<form><p>no</p><input></form><table><tr><td>a<td>b</table>", ["a", "b"]),
        ("<p title='a>b'>c</p><P CLASS=Sidebar>no</P><a href=x>link</a> text", ["c", "link text"]),
        ("<article><p>in</p></article><p>out</p>", ["in", "out"]),
        ("<b>bo</b>ld<i> it</i>", ["bold it"]),
        ("<p a='x", []),
    ],
)
def test_lines_of_markup(page, want):
    assert lines(page) == want


def test_very_long_and_broken_pages_take_linear_time():
    assert len(lines("<p>x" * 100_000)) == 100_000
    assert lines("<div>" * 20_000 + "deep") == ["deep"]
    lines("<a '" * 20_000)
    lines("<" * 200_000)
    lines("<div>" * 20_000 + "</b>" * 20_000 + "</div>" * 20_000)


@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
@settings(max_examples=300, deadline=None)
def test_alignment_is_a_longest_common_subsequence(left, right):
    @functools.cache
    def best(i, j):
        if i == len(left) or j == len(right):
            return 0
        return max(best(i + 1, j), best(i, j + 1), 1 + best(i + 1, j + 1) if left[i] == right[j] else 0)

    places = pages.aligned(left, right)
    assert places == sorted(set(places)) and len(places) == best(0, 0)
    it = iter(right)
    assert all(left[p] in it for p in places)


@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30), st.sampled_from([1, 20, 60]))
@settings(max_examples=300, deadline=None)
def test_alignment_in_little_memory(left, right, bits):
    want, before = len(pages.aligned(left, right)), pages.ROW_BITS
    pages.ROW_BITS = bits
    try:
        places = pages.aligned(left, right)
    finally:
        pages.ROW_BITS = before
    assert places == sorted(set(places)) and len(places) == want
    it = iter(right)
    assert all(left[p] in it for p in places)


def test_very_many_lines_are_aligned_in_bounded_memory():
    code = """
import random, resource
from barrelbook.llm.pages import aligned
n, pick = 150_000, random.Random(1)
left = list(range(n))
right = [x for i in range(0, n, 1000) for x in sorted(range(i, i + 1000), key=lambda x: x // 100 * (-1) ** (x % 2))]
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = aligned(left, right)
it = iter(right)
assert all(x in it for x in found) and len(found) > n / 10
assert len(aligned(left, [n + x for x in left])) == 0
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert int(done.stdout) < 1_000_000  # KB


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>A.</p><p class=share>Shares fell sharply on Monday.</p></article>", ["A.", "Shares fell sharply on Monday."]),
        ("<article><p>A.</p><div class='share-price-analysis'>Prices.</div></article>", ["A.", "Prices."]),
        ("<article><section class='related work'><p>Others did.</p></section></article>", ["Others did."]),
        ("<article><h2 id=comments>Comments on the text</h2><p>B.</p></article>", ["Comments on the text", "B."]),
        ("<article><p>A.</p><div class='ad wide'>no</div><div class='related-posts'>no</div><div id=comment-list>no</div></article>", ["A."]),
        ("<p>Press <button>OK</button> to go on.</p>", ["Press to go on."]),
    ],
)
def test_class_words_do_not_cut_articles(page, want):
    assert lines(page) == want


def brute_texts(rows):
    """The query by its definition, for pages of plain paragraphs, some of them in an article element."""
    parsed = {}
    for i, url, page in rows:
        host, _, path = url.split("://", 1)[1].partition("/")
        parsed[i] = (host, "/" + path.partition("?")[0], [(t, bool(a)) for a, t in re.findall(r"<(article)?(?:><)?p>([^<]*)</p>", page)])
    order = sorted(parsed, key=lambda i: (parsed[i][0], parsed[i][1], i))

    def shared(own, other):
        table = [[0] * (len(other) + 1) for _ in range(len(own) + 1)]
        for i in range(len(own) - 1, -1, -1):
            for j in range(len(other) - 1, -1, -1):
                table[i][j] = max(table[i + 1][j], table[i][j + 1], table[i + 1][j + 1] + 1 if own[i] == other[j] else 0)
        i = j = 0
        found = set()
        while i < len(own) and j < len(other):
            if own[i] == other[j] and table[i][j] == table[i + 1][j + 1] + 1:
                found.add(i)
                i, j = i + 1, j + 1
            elif table[i + 1][j] >= table[i][j + 1]:
                i += 1
            else:
                j += 1
        return found

    out = {}
    for n, i in enumerate(order):
        host, path, own = parsed[i]
        near = [k for k in (order[n - 1] if n else None, order[n + 1] if n + 1 < len(order) else None) if k is not None and parsed[k][0] == host]
        near.sort(key=lambda k: -len(os.path.commonprefix([path, parsed[k][1]])))
        template = set()
        size = sum(len(t) for t, _ in own)
        for most in (0.9, 1.0):
            for k in near if not template else []:
                same = shared([t for t, _ in own], [t for t, _ in parsed[k][2]])
                if len(same) < len(own) and sum(len(own[x][0]) for x in same) <= most * size:
                    template = template or same
        left = [(t, a) for x, (t, a) in enumerate(own) if x not in template]
        marked = sum(len(t) for t, a in left if a)
        if any(a for _, a in own) and 2 * marked >= sum(len(t) for t, _ in left):
            left = [(t, a) for t, a in own if a]
        out[i] = "\n".join(t for t, _ in left)
    return out


def test_main_texts_as_by_brute_force(spark):
    """Shared lines, copies, long templates and articles; on most of these pages the alignment decides."""
    pick = random.Random(9)
    rows = []
    for i in range(150):
        host = f"h{i % 4}.org"
        blocks = [f"<p>{host} menu {k} " + "x" * pick.choice([1, 80]) + "</p>" for k in range(4)]
        body = [f"<p>story {i} part {k}</p>" for k in range(pick.randint(0, 3))]
        if pick.random() < 0.3:
            body.append(f"<article><p>teaser {pick.randint(0, 3)} of {host}</p></article>")
        if pick.random() < 0.2:
            body.insert(0, f"<article><p>article {i} " + "y" * 60 + "</p></article>")
        rows.append((i, f"http://{host}/{pick.choice('ab')}/{pick.randint(0, 9)}{i}", "".join([*blocks[:2], *body, *blocks[2:]])))
    rows += [(200 + i, rows[5][1] + "?", rows[5][2]) for i in range(4)]  # copies
    found = texts(spark.createDataFrame(rows, PAGES).repartition(5))
    want = brute_texts(rows)
    assert found == want
    plain = {i: "\n".join(re.findall("<p>([^<]*)</p>", page)) for i, _, page in rows}
    assert sum(found[i] != plain[i] for i in found) > 100


def texts(frame):
    return {r.page_id: r.text for r in pages.main_texts(frame).collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_template_lines_go(spark, partitions):
    """Pages without article elements lose what they share with their neighbours, wherever partitions end."""
    def page(i, host):
        template = f"<div>Welcome to {host}</div><div>Topics</div>"
        return f"{template}<p>story {host} {i} alpha</p><p>shared word</p>" + f"<p>story {i} end</p>" * 2 + "<div>All rights</div>"

    rows = [(i, f"https://{h}/x/{i:03d}", page(i, h)) for i, h in enumerate(["a.org"] * 30 + ["b.org"] * 9)]
    rows += [(100, "https://alone.org/1", "<div>only</div>"), (101, "https://c.org/1", "<p>same</p>"), (102, "https://c.org/2", "<p>same</p>")]
    rows += [(103, None, None), (103, None, None), (104, "x", ""), (None, "https://d.org/", "<p>n</p>")]
    frame = spark.createDataFrame(rows, PAGES).repartition(partitions)
    frame = frame.withColumns({n: F.lit("x") for n in ("host", "path", "th", "text", "template", "hashes")})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = texts(frame)
        assert pages.main_texts(frame).count() == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, host in enumerate(["a.org"] * 30 + ["b.org"] * 9):
        assert found[i] == f"story {host} {i} alpha\nstory {i} end\nstory {i} end"
    assert found[100] == "only" and found[101] == found[102] == "same"  # copies keep their text
    assert found[103] == "" and found[104] == "" and found[None] == "n"


def test_marked_articles_stay_whole(spark):
    rows = [(i, f"http://h.net/{i}", f"<p>site</p><article><p>shared</p><p>own {i}</p></article><footer>f</footer>") for i in range(6)]
    frame = spark.createDataFrame(rows, PAGES)
    assert texts(frame) == {i: f"shared\nown {i}" for i in range(6)}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>a</p></article><article class=comment><p>no</p></article>", ["a"]),
        ("<article class='post comments-open has-sidebar'><p>a</p></article>", ["a"]),
        ("<article id=div-comment-12 class='comment-body even'><p>no</p></article><p>b</p>", ["b"]),
        ("<article><p>a</p></article><div id=comments><article><p>no</p></article><article>no</article></div><p>b</p>", ["a", "b"]),
        ("<aside><article>no</article></aside><article>a</article>", ["a"]),
        ("<div class=ad>no<article><p>a</p></article>", ["a"]),  # never closed
        ("<form><article><p>a</p></article></form>", ["a"]),
        ("<div class='has-sidebar'><article><p>a</p></article></div>", ["a"]),
    ],
)
def test_articles_that_are_no_main_text(page, want):
    assert lines(page) == want


def test_nested_asides_take_linear_time():
    assert lines("<aside>" * 20_000 + "<article>no</article>" * 20_000 + "</aside>" * 20_000) == []


def test_main_text_beside_articles(spark):
    """Teasers are articles here, and the main text stands in plain elements."""
    teasers = "<article><h2>Other story</h2></article><article><h2>One more story</h2></article>"
    rows = [(i, f"http://t.org/{i}", f"<div>Site</div><div><p>The long story number {i} goes on.</p></div>{teasers}") for i in range(5)]
    assert texts(spark.createDataFrame(rows, PAGES)) == {i: f"The long story number {i} goes on." for i in range(5)}


def test_short_texts_in_long_templates(spark):
    """Nine tenths of each page are shared, and still they are no copies."""
    rows = [(i, f"http://l.org/{i}", f"<div>{'Words of the site. ' * 20}</div><p>own {i}</p>") for i in range(5)]
    assert texts(spark.createDataFrame(rows, PAGES)) == {i: f"own {i}" for i in range(5)}


def test_empty_table(spark):
    assert pages.main_texts(spark.createDataFrame([], PAGES)).collect() == []


def test_given_pages(spark):
    """The given pages hold one article element each; its paragraphs by plain splitting."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = texts(table)
    for row in table.collect():
        article = row.html.split("<article>", 1)[1].split("</article>", 1)[0]
        blocks = [re.sub(r"</?b>|</?p>|</h1>|<br>", " ", b) for b in re.split(r"<p>|<h1>|</p>|</h1>", article)]
        want = [" ".join(html.unescape(b).split()) for b in blocks]
        assert found[row.page_id] == "\n".join(b for b in want if b)
