"""Main text of web pages by differencing each page with its nearest neighbour by URL.

Pages of a host are put in order of their paths. Each page is paired with the neighbour that
shares the longer beginning of the path, the text lines of both are aligned by a longest common
subsequence, and lines that both share are template, not text. Markup settles what it can settle
alone: lines of navigation, forms, notices and the like are never text, and lines inside of an
article element are text even if the neighbour quotes them too.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barrelbook.llm.urls import host_of, path_of
from barrelbook.session import checkpointed, scratch_path

_TAG = re.compile(
    r"""<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>
    |</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")

# Fixed values of the HTML standard.
RAW = frozenset("script style noscript template textarea title svg math iframe object select head canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without article text, wherever they stand.
ASIDE = frozenset("nav aside form menu dialog button fieldset search footer".split())
#: Words of classes, ids and roles that name such elements.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies dialog disqus footer gdpr masthead menu modal nav navbar "
    "navigation newsletter notice notification pagination popup promo related reply replies respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Those that name an aside inside of an article too, whatever other classes stand beside them.
PLAIN_ASIDES = frozenset(
    "ad ads advert advertisement advertising adverts breadcrumb breadcrumbs comment comments cookie cookies disqus "
    "gdpr modal nav navbar navigation newsletter pagination popup sidebar signup sponsored subscribe".split()
)
#: Elements of running text: inside of an article no class makes them an aside.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre a b i em strong span mark u s q cite code small sub sup".split())
TEXT = frozenset(("article", "main"))
#: Parts of class names and ids that say nothing beside words of ASIDE_WORDS.
NEUTRAL = frozenset("area block body box card content div entry item items list post posts section thread wrapper".split())


def _names_aside(rest: str) -> bool:
    """Whether a class name or id consists of words of ASIDE_WORDS; ``comment-body`` does, ``comments-open`` does not."""
    for match in _ATTRIBUTE.finditer(rest):
        if match[1].lower() in ("class", "id"):
            for token in (match[2] or match[3] or match[4] or "").lower().split():
                words = {w for w in _WORD.findall(token) if not w.isdigit()} - NEUTRAL
                if words and words <= ASIDE_WORDS:
                    return True
    return False


def _ends(page: str) -> dict[int, int]:
    """Where the end tag of each closed element begins, by the place of its start tag."""
    opened: dict[str, list[int]] = {}
    ends = {}
    for match in _TAG.finditer(page):
        if match["name"]:
            places = opened.setdefault(match["name"].lower(), [])
            if not match["end"]:
                places.append(match.start())
            elif places:
                ends[places.pop()] = match.start()
    return ends


def _is_aside(name: str, rest: str, inside_text: bool) -> bool:
    """Whether an element is no article text. Inside of an article a class or id says so only if all
    its words do, or one of PLAIN_ASIDES stands alone, and never of running text."""
    if name in ASIDE or (name == "header" and not inside_text):
        return True
    if name == "article" and _names_aside(rest):
        return True
    if name in TEXT or name in ("html", "body") or "=" not in rest and "hidden" not in rest.lower():
        return False
    for match in _ATTRIBUTE.finditer(rest):
        key = match[1].lower()
        value = (match[2] or match[3] or match[4] or "").lower()
        if key in ("class", "id", "role"):
            words = _WORD.findall(value)
            if key == "role" and "form" in words:
                return True
            if inside_text and key != "role":
                said = {w for w in words if not w.isdigit()} - NEUTRAL
                if name not in RUNNING and said and (said <= ASIDE_WORDS or not PLAIN_ASIDES.isdisjoint(value.split())):
                    return True
            elif not ASIDE_WORDS.isdisjoint(words):
                return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def text_lines(page: str | None) -> list[tuple[str, bool]]:
    """The text of each block in page order, and whether it stands in an article element.

    Elements that markup shows to be no article text are left out. Such an element ends at its end
    tag, with any element around it, or where an article begins; but articles inside of an aside,
    a footer or an element named after comments and the like belong to it if its end tag follows.
    """
    page = page or ""
    lines: list[tuple[str, bool]] = []
    words: list[str] = []
    # name, left out, in an article, where an element that keeps articles out begins
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, -1)]
    ends: dict[int, int] | None = None
    opened: Counter[str] = Counter()
    at = 0

    def flush() -> None:
        line = " ".join(entities.unescape("".join(words)).split())
        if line:
            lines.append((line, stack[-1][2]))
        words.clear()

    while True:
        match = _TAG.search(page, at)
        if not stack[-1][1]:
            words.append(page[at : match.start() if match else len(page)])
        if match is None:
            break
        at = match.end()
        name = match["name"]
        if name is None:
            continue
        name = name.lower()
        if match["end"]:
            if name in BLOCKS:
                flush()
            while opened[name]:  # the element and what it left open
                if stack[-1][0] in BLOCKS:
                    flush()
                opened[stack[-1][0]] -= 1
                if stack.pop()[0] == name:
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I)
            found = close.search(page, at)
            if name != "head":
                if not match["rest"].endswith("/") or name not in ("svg", "math"):
                    at = found.end() if found else len(page)
            elif found:
                at = found.end()
            continue
        if name in VOID:
            if name in ("br", "hr"):
                words.append(" ")
            if name == "hr":
                flush()
            continue
        if name in BLOCKS:
            flush()
            if name == "p" and stack[-1][0] == "p":
                opened["p"] -= 1
                stack.pop()
        left_out, inside = stack[-1][1], stack[-1][2]
        if name in TEXT and not inside and left_out:
            if ends is None and stack[-1][3] >= 0:
                ends = _ends(page)
            if stack[-1][3] < 0 or ends.get(stack[-1][3], -1) < at:
                while stack[-1][1]:
                    opened[stack.pop()[0]] -= 1
                left_out, inside = stack[-1][1], stack[-1][2]
        inside = inside or name in TEXT
        if match["rest"].endswith("/") and name not in BLOCKS:
            continue
        opened[name] += 1
        keeps = stack[-1][3]
        if not left_out and _is_aside(name, match["rest"], inside):
            left_out = True
        if left_out and keeps < 0 and (name in ("aside", "footer") or _names_aside(match["rest"])):
            keeps = match.start()
        stack.append((name, left_out, inside, keeps))
    flush()
    return lines


#: Bits of the rows that an alignment keeps at a time.
ROW_BITS = 1 << 28


def _step(row: int, full: int, hits: list[int]) -> int:
    """The next row of the alignment: a zero at j is one more match with the right side up to j."""
    hit = 0
    for j in hits:
        hit |= 1 << j
    hit &= row
    return ((row + hit) | (row - hit)) & full


def _places(b: list[int]) -> dict[int, list[int]]:
    places: dict[int, list[int]] = {}
    for j, value in enumerate(b):
        places.setdefault(value, []).append(j)
    return places


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each beginning of ``b``."""
    places, full = _places(b), (1 << len(b)) - 1
    row = full
    for value in a:
        if value in places:
            row = _step(row, full, places[value])
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits[: len(b)].astype(np.int64))])


def _matches(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence. Rows that would take more than ``ROW_BITS`` are
    not kept: ``a`` is halved and ``b`` cut where the lengths of both halves add up to most."""
    common = set(a) & set(b)
    own = [i for i, value in enumerate(a) if value in common]
    a, b = [a[i] for i in own], [value for value in b if value in common]
    if not a:
        return []
    if len(a) > 1 and len(a) * len(b) > ROW_BITS:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[:half - 1 : -1], b[::-1])[::-1]))
        found = [*_matches(a[:half], b[:cut]), *(half + i for i in _matches(a[half:], b[cut:]))]
        return [own[i] for i in found]
    places, full = _places(b), (1 << len(b)) - 1
    row, rows = full, []
    for value in a:
        row = _step(row, full, places[value])
        rows.append(row)
    chosen, j = [], len(b)
    for i in range(len(a) - 1, -1, -1):
        if j == 0:
            break
        before = rows[i - 1] if i else full
        while j and rows[i] >> (j - 1) & 1:
            j -= 1
        if j and before >> (j - 1) & 1:  # the match is new in this row
            chosen.append(own[i])
            j -= 1
    return chosen[::-1]


def aligned(left: list[int], right: list[int]) -> list[int]:
    """Places in ``left`` of a longest common subsequence, bit-parallel over ``right``, in bounded memory."""
    begin = 0
    while begin < min(len(left), len(right)) and left[begin] == right[begin]:
        begin += 1
    end = 0
    while end < min(len(left), len(right)) - begin and left[-1 - end] == right[-1 - end]:
        end += 1
    found = _matches(left[begin : len(left) - end], right[begin : len(right) - end])
    return [*range(begin), *(begin + i for i in found), *range(len(left) - end, len(left))]


def template_lines(own: list[int], sizes: list[int], other: list[int], most: float = 0.9) -> list[int]:
    """Lines that a page shares with its neighbour; none if it has no line of its own, or less than
    ``1 - most`` of its text."""
    shared = aligned(own, other)
    if len(shared) == len(own) or sum(sizes[i] for i in shared) > most * sum(sizes):
        return []
    return shared


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parsed = [text_lines(page) for page in batch.column("html").to_pylist()]
        hashes = [[xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) >> 1 for t, _ in lines] for lines in parsed]
        sizes = [[len(t) for t, _ in lines] for lines in parsed]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(n) for n in ("host", "path", "page_id", "th")),
                pa.array(hashes, pa.list_(pa.int64())),
                pa.array(sizes, pa.list_(pa.int32())),
            ],
            names=[f.split()[0] for f in SIGNATURE.split(", ")],
        )


SIGNATURE = "host string, path string, page_id long, th long, hashes array<long>, sizes array<int>"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last row of a partition."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = batch.slice(0, 1) if first is None else first
            last = batch.slice(batch.num_rows - 1, 1)
    for place, row in enumerate((first, last)):
        if row is not None:
            where = [pa.array([TaskContext.get().partitionId()]), pa.array([place])]
            yield pa.RecordBatch.from_arrays([*where, *row.columns], names=["partition", "place", *row.schema.names])


def _choose(row: dict, before: dict | None, after: dict | None) -> list[int]:
    """Template lines of a page by its nearest neighbour, or by the other one if that is a copy but
    for a tenth. If both are, the page is mostly template, and only lines of its own have to be left."""
    near = [n for n in (before, after) if n is not None and n["host"] == row["host"]]
    near.sort(key=lambda n: -len(commonprefix([n["path"], row["path"]])))
    for most in (0.9, 1.0):
        for other in near:
            shared = template_lines(row["hashes"], row["sizes"], other["hashes"], most)
            if shared:
                return shared
    return []


def _differences(edges: dict[int, tuple]):
    """Compare every page of a sorted partition with both neighbours, across partition borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after_all = edges.get(TaskContext.get().partitionId(), (None, None))
        held = None

        def compare(row: dict, following: dict | None) -> list[tuple]:
            found = _choose(row, before, following)
            return [(row["page_id"], row["th"], found)] if found else []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["page_id", "th", "template"]
            )

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is not None:
                    out += compare(held, row)
                    before = held
                held = row
            yield batch_of(out)
        yield batch_of(compare(held, after_all) if held is not None else [])

    return run


def templates(pages: DataFrame) -> DataFrame:
    """``(page_id, th, template)``: places of the template lines of pages.

    ``pages`` has ``page_id, url, html``. Only hashes of lines are put in order. A host with very
    many pages is cut into ranges; what crosses a border is one row of hashes per partition.
    """
    slim = pages.select(
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
        "page_id",
        F.xxhash64("html").alias("th"),
        "html",
    )
    signed = checkpointed(slim.mapInArrow(_signatures, SIGNATURE))
    order = ["host", "path", "page_id", "th"]
    dealt = checkpointed(signed.repartitionByRange(*order).sortWithinPartitions(*order))
    rows = dealt.mapInArrow(_edges, f"partition long, place long, {SIGNATURE}").collect()  # two per partition
    ends = {(r.partition, r.place): r.asDict() for r in rows}
    used = sorted({partition for partition, _ in ends})
    edges = {
        p: (ends[used[n - 1], 1] if n else None, ends[used[n + 1], 0] if n + 1 < len(used) else None)
        for n, p in enumerate(used)
    }
    found = dealt.mapInArrow(_differences(edges), "page_id long, th long, template array<int>")
    return found.groupBy("page_id", "th").agg(F.min("template").alias("template"))


def main_lines(lines: list[tuple[str, bool]], template: set[int]) -> list[str]:
    """Lines of the main text by two votes: whether markup has a line in an article, and whether it is the page's own.

    If articles hold at least half of the page's own text, they are the main text, with lines that
    they share. Otherwise the main text stands elsewhere: all own lines are kept.
    """
    own = [len(t) * (place not in template) for place, (t, _) in enumerate(lines)]
    marked = sum(n for n, (_, inside) in zip(own, lines) if inside)
    if any(inside for _, inside in lines) and 2 * marked >= sum(own):
        return [t for t, inside in lines if inside]
    return [t for place, (t, _) in enumerate(lines) if place not in template]


@F.pandas_udf(T.StringType())
def _text(pages: pd.Series, templates: pd.Series) -> pd.Series:
    out = []
    for page, template in zip(pages, templates):
        gone = set() if template is None else set(map(int, template))
        out.append("\n".join(main_lines(text_lines(page), gone)))
    return pd.Series(out)


def main_texts(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Every page is compared with its nearest neighbour by URL. If article and main elements hold at
    least half of what the two do not share, the page gives the blocks inside of them; otherwise it
    gives all blocks that are not shared. If nine tenths of a page are shared, the other neighbour
    is asked; a page without a block of its own is a copy and keeps all. NULL html is empty and gives an
    empty text; a NULL URL has an empty host and path; repeated rows and NULL ids stay as they are;
    an empty table gives no rows. The template lines are joined from a written table, so Spark
    knows its size and broadcasts it only if it is small.
    """
    spark = pages.sparkSession
    own = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    )
    path = scratch_path(spark, "page-templates")
    templates(own).write.parquet(path)
    found = spark.read.schema("page_id long, th long, template array<int>").parquet(path)
    found = found.select(F.col("page_id").alias("found_id"), F.col("th").alias("found_th"), "template")
    same = (F.xxhash64(own.html) == found.found_th) & own.page_id.eqNullSafe(found.found_id)
    text = own.join(found, same, "left").select("page_id", "url", _text("html", "template").alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
