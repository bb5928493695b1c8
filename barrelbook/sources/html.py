"""Rows from stored web pages.

Flat markup is read with JVM regular expressions. Nested repeated elements need a
tag stack: a small scanner runs per Arrow batch, each page on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The predefined entities, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

ITSELF = "."  # field spec: the repeated element itself


def unescape(text: Column) -> Column:
    """Predefined entities as characters."""
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def page_title(html: Column) -> Column:
    """Text of the title element; NULL without one."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), F.btrim(unescape(found)))


def shown(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    hidden = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
    return F.when(html.rlike(r"(?i)<(?:!--|script|style)"), F.regexp_replace(html, hidden, "")).otherwise(html)


def page_links(pages: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """One row per link with its position, target and text. Comments, scripts and styles have no links."""
    pages = pages.select(*keep, shown(F.col(html)).alias("_shown"))
    within = r"""(?:[^>"']|"[^"]*"|'[^']*')*?"""  # whole values, so that none is taken for a name
    pattern = (
        rf"""(?is)<a(?=\s){within}\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)){within}>(.*?)</a>"""
    )
    found = [F.regexp_extract_all("_shown", F.lit(pattern), F.lit(group)) for group in (1, 2, 3, 4)]
    targets = F.transform(F.arrays_zip(*[f.alias(f"v{i}") for i, f in enumerate(found[:3])]), lambda v: F.concat(v["v0"], v["v1"], v["v2"]))
    texts = found[3]
    pairs = pages.select(*keep, F.posexplode(F.arrays_zip(targets.alias("href"), texts.alias("text"))))
    return pairs.select(
        *keep,
        F.col("pos").cast("bigint").alias("position"),
        unescape(F.col("col.href")).alias("href"),
        unescape(F.regexp_replace("col.text", r"<[^>]*>", "")).alias("text"),
    )


def extract_items(
    pages: DataFrame,
    html: str,
    fields: Mapping[str, tuple[str | None, str | None, str | None]],
    keep: Sequence[str],
    item: tuple[str, str | None] | None = None,
    unless: str | None = None,
) -> DataFrame:
    """One row per element ``item = (tag, class)``, or per page without ``item``.

    ``fields`` names what to take from inside: ``(tag, class, attribute)``, where None
    matches any tag or class, ``#name`` in place of a class matches the id, and no
    attribute means the text of the first match.
    A page with an element of the class ``unless`` has no items.
    The tag ``ITSELF`` addresses the item's own attributes. Absent fields are NULL. An item
    nested in another belongs to the outer one.
    """
    source = pages.select(*keep, html)
    columns = [source.schema[c] for c in keep]
    schema = T.StructType(
        [*columns, T.StructField("position", T.LongType())]
        + [T.StructField(name, T.StringType()) for name in fields]
    )
    keep, specs = list(keep), dict(fields)

    def parse(batches: Iterator) -> Iterator:
        # Self-contained, so that executors need nothing but the standard library and pandas.
        import re
        from functools import lru_cache
        from html import unescape as characters

        import pandas as pd

        void = {"br", "img", "hr", "input", "meta", "link", "source", "area", "base", "col", "embed", "wbr"}
        # A piece of markup and the text after it, or text that begins with a stray "<".
        markup = re.compile(
            r"<(?:!--.*?(?:-->|\Z)|(?:script|style)\b.*?(?:</(?:script|style)\s*>|\Z)|[!?][^>]*>"
            r"|(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>)([^<]*+)|(<[^<]*+)",
            re.S | re.I,
        )
        attribute = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
        own = [(name, wanted) for name, (tag, _, wanted) in specs.items() if tag == ITSELF]
        inner = {name: spec for name, spec in specs.items() if spec[0] != ITSELF}
        by_tag = {
            tag: [(name, css, wanted) for name, (t, css, wanted) in inner.items() if t in (tag, None)]
            for tag in {t for t, _, _ in inner.values()}
        }
        anywhere = by_tag.get(None, [])

        def attributes(raw):
            found = {}
            for key, *values in attribute.findall(raw):
                found.setdefault(key.lower(), characters(next(filter(None, values), "")))
            return found

        def possible(css, raw):
            """Whether raw attributes may hold a class or id, before they are taken apart."""
            return css is None or css.lstrip("#") in raw or "&" in raw

        def fits(css, found):
            if css is None:
                return True
            if css.startswith("#"):
                return found.get("id") == css[1:]
            return css in found.get("class", "").split()

        def read(tag, raw):
            """What a start tag says: its name, whether the page has no items, the own fields of the item
            that it may open, and the fields that it may give inside one."""
            tag, found = tag.lower(), None
            asked = [(name, css, wanted) for name, css, wanted in by_tag.get(tag, anywhere) if possible(css, raw)]
            opens = item is not None and tag == item[0] and possible(item[1], raw)
            bad = unless is not None and bool(raw) and possible(unless, raw)
            if asked or opens or bad:
                found = attributes(raw)
            fields = [(name, wanted is None, found.get(wanted)) for name, css, wanted in asked if fits(css, found)]
            mine = {name: found[wanted] for name, wanted in own if wanted in found} if opens and fits(item[1], found) else None
            return tag, bad and fits(unless, found), mine, fields

        recent = lru_cache(2048)(read)  # short tags repeat from element to element

        def items(page):
            """Dicts of found fields. ``stack`` holds the open tags, ``capturing`` the fields
            whose text is being collected, with the stack height that ends them."""
            done, stack, capturing = [], [], []
            current, inside = (None, 0) if item else ({}, 0)
            for closing, tag, raw, data, stray in markup.findall(page):
                if closing:
                    tag = tag.lower()
                    if tag in stack:
                        while stack.pop() != tag:
                            pass
                        height = len(stack)
                        if capturing:
                            capturing = [field for field in capturing if field[1] <= height]
                        if item and current is not None and height < inside:
                            done.append(current)
                            current, capturing = None, []
                elif tag:
                    tag, bad, mine, given = (recent if len(raw) < 256 else read)(tag, raw)
                    if bad:
                        return []
                    if tag not in void:
                        stack.append(tag)
                    if current is None:
                        if mine is not None:
                            current, inside = dict(mine), len(stack)
                    else:
                        for name, of_text, value in given:
                            if name not in current:
                                current[name] = "" if of_text else value
                                if of_text and tag not in void:
                                    capturing.append((name, len(stack)))
                if capturing:
                    text = characters(data or stray)
                    for name, _ in capturing:
                        current[name] += text
            if current is not None:
                done.append(current)
            return done

        for batch in batches:
            rows = [
                (*record[:-1], position, *[found.get(name) for name in specs])
                for record in batch.itertuples(index=False)
                for position, found in enumerate(items(record[-1] or ""))
            ]
            yield pd.DataFrame(rows, columns=[*keep, "position", *specs])

    return source.mapInPandas(parse, schema)
