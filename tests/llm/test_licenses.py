from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barrelbook.llm import licenses

INDEX = licenses.Index(licenses.TEMPLATES)


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_every_template_is_found_with_its_span(name):
    text = licenses.TEMPLATES[name]
    page = f"Ünten thé shan. {text.upper()}\nmore words here. {text}"
    found = {n: (c, spans) for n, c, _, _, spans in licenses.scan(page, INDEX, 0.8)}
    coverage, spans = found[name]
    assert coverage == 1 and len(spans) == 2
    for begin, end in spans:
        assert licenses.words_of(page[begin:end])[0] == licenses.words_of(text)[0]


@given(st.lists(st.integers(0, 3), min_size=3, max_size=30))
@settings(max_examples=200, deadline=None)
def test_winnowing_leaves_a_fingerprint_in_every_window(values):
    codes = np.array(values, dtype=np.int64)
    chosen = set(licenses.winnowed(codes).tolist())
    for start in range(len(codes) - licenses.WINDOW + 1):
        assert chosen & set(range(start, start + licenses.WINDOW))


def full_alignment(template, text):
    """Score of the best local alignment without a band."""
    best, above = 0, [0] * (len(text) + 1)
    for word in template:
        row = [0]
        for j, other in enumerate(text):
            row.append(max(0, above[j] + (2 if word == other else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max([best, *row]), row
    return best


@given(st.lists(st.integers(0, 3), min_size=1, max_size=10), st.lists(st.integers(0, 3), min_size=1, max_size=10))
@settings(max_examples=200, deadline=None)
def test_alignment_against_the_full_table(template, text):
    matched, begin, end = licenses.align(template, text, 0, 12)
    score = full_alignment(template, text)
    assert (matched == 0) == (score == 0)
    if matched:
        assert 0 <= begin < end <= len(text)
        assert full_alignment(template, text[begin:end]) == score
        assert score <= 2 * matched


def test_changed_and_partial_notices():
    words = licenses.TEMPLATES["MIT-text"].split()
    rng = random.Random(3)
    changed = [w if rng.random() > 0.08 else "other" for w in words]
    del changed[20]
    changed.insert(60, "inserted words")
    found = {n: c for n, c, *_ in licenses.scan("x " * 50 + " ".join(changed), INDEX, 0.8)}
    assert 0.8 <= found["MIT-text"] < 1
    assert "MIT-text" not in {n for n, *_ in licenses.scan(" ".join(words[:70]), INDEX, 0.8)}


@pytest.mark.parametrize(
    ("text", "license"),
    [
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0-short"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0-short"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Licensed under CC BY-NC 3.0.", None),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 2.1.", None),
        ("This work is licensed under the GNU General Public License, version 3.0.", "GPL-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This work is licensed under the GNU Library General Public License, version 2.", None),
        ("Licensed under the Apache License, Version 1.0.", None),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Released under the BSD License.", None),
        (licenses.TEMPLATES["CC-BY-SA-4.0"], "CC-BY-SA-4.0"),
        (licenses.TEMPLATES["CC-BY-NC-SA-4.0"].replace("NonCommercial", "Non-Commercial"), "CC-BY-NC-SA-4.0"),
        (licenses.TEMPLATES["Apache-2.0-header"], "Apache-2.0-header"),
        (licenses.TEMPLATES["GPL-2.0-header"], "GPL-2.0-header"),
    ],
)
def test_licenses_that_differ_by_a_word(text, license):
    found = [n for n, *_ in licenses.scan(f"Ünten shan 7. {text} 2024 more words", INDEX, 0.8)]
    assert found == ([license] if license else [])


@pytest.mark.parametrize("name", [n for n in licenses.TEMPLATES if n.endswith("-full")])
def test_changed_whole_texts(name):
    rng = random.Random(8)
    text = " ".join(w if rng.random() > 0.03 or any(c in w for c in "0123456789") else "other" for w in licenses.TEMPLATES[name].split())
    found = {n: c for n, c, *_ in licenses.scan("x " * 50 + text + " y" * 50, INDEX, 0.8)}
    assert list(found) == [name] and 0.9 < found[name] < 1


def test_scan_of_documents(spark, documents, clashing):
    notice = licenses.TEMPLATES["Apache-2.0"]
    rows = [(1, notice), (1, notice), (None, "x " + notice), (2, None), (3, ""), (4, "under the licensed apache"), (5, "word " * 100_000 + notice)]
    rows += [(6, (notice + "\n") * 200), (7, "licensed under the"), (8, "İé " + notice)]
    got = licenses.licenses(clashing(documents(rows)))
    got = got.filter("license = 'Apache-2.0'").collect()
    assert sorted((r.doc_id or 0, len(r.spans), r.coverage) for r in got) == [(0, 1, 1.0), (1, 1, 1.0), (1, 1, 1.0), (5, 1, 1.0), (6, 200, 1.0), (8, 1, 1.0)]
    assert [(s.start, s.end) for r in got if r.doc_id == 8 for s in r.spans] == [(3, 3 + len(notice) - 1)]
    assert licenses.licenses(documents([])).collect() == []


def test_given_documents_against_plain_search(spark):
    """Every line that is a template, and nothing on documents without such words."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license) for r in licenses.licenses(table).collect()}
    want = set()
    for row in table.select("doc_id", "text").collect():
        for name, text in licenses.TEMPLATES.items():
            if text in (row.text or ""):
                want.add((row.doc_id, name))
    assert want and want <= got
    wrong = got - want
    texts = {r.doc_id: " ".join(x.decode() for x in licenses.words_of(r.text)[0]) for r in table.filter(F.col("doc_id").isin([d for d, _ in wrong] or [-1])).collect()}
    for doc_id, name in wrong:  # a notice that is changed a little
        assert any(w in texts[doc_id] for w in ("licen", "copyright", "reserved")), name
