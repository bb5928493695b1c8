from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from barrelbook.llm import suffixes


def brute_spans(texts, span):
    starts = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for text in texts:
        covered = set()
        for i in range(len(text) - span + 1):
            if starts[text[i : i + span]] > 1:
                covered.update(range(i, i + span))
        runs, last = [], None
        for i in sorted(covered):
            if last is None or i != last + 1:
                runs.append([i, i + 1])
            else:
                runs[-1][1] = i + 1
            last = i
        out.append([tuple(r) for r in runs])
    return out


@given(st.lists(st.integers(1, 4), max_size=120))
@settings(max_examples=200, deadline=None)
def test_two_stage_order(values):
    data = np.array([*values, 0], dtype=np.uint8)
    order = suffixes.two_stage_order(data, len(data))
    suffix = [data[i:].tobytes() for i in range(len(data))]
    assert [suffix[i] for i in order] == sorted(suffix)


@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_repeated_windows(texts):
    span = 8
    starts = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    want = [[i for i in range(len(t) - span + 1) if starts[t[i : i + span]] > 1] for t in texts]
    assert [list(x) for x in suffixes.repeated_windows(texts, span)] == want


def collect(frame, **how):
    from pyspark.sql import functions as F

    found = suffixes.with_repeated_spans(frame, "spans", **how)
    found = found.withColumn("kept", suffixes.kept_bytes("text", "spans"))
    return sorted(
        ((r.doc_id, r.text, [(s.start, s.end) for s in r.spans or []], bytes(r.kept)) for r in found.collect()),
        key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""),
    )


def check(frame, rows, span, **how):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    texts = [(t or "").encode() for _, t in rows]
    want = brute_spans(texts, span)
    got = collect(frame, span=span, **how)
    assert [(i, t) for i, t, _, _ in got] == rows
    for (i, t, spans, kept), expected, data in zip(got, want, texts):
        assert spans == expected, i
        gone = {x for s, e in expected for x in range(s, e)}
        assert kept == bytes(b for x, b in enumerate(data) if x not in gone)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ß") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(14) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, "x"), (3, "ab" * 120), (4, "z" * 90), (4, "z" * 90), (None, passages[0])]
    for i in range(10, 60):
        parts = [text(rng.randrange(3, 30))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages)[rng.randrange(0, 8) :], text(rng.randrange(0, 12))]
        rows.append((i, "\n".join(parts)))
    rows += [(70 + i, rows[12][1]) for i in range(5)] + [(80, rows[13][1] + "!"), (81, "?" + rows[13][1])]
    return rows


def test_spans_match_brute_force(spark, documents, clashing):
    rows = corpus(3)
    check(clashing(documents(rows)), rows, 24, gram=10)


def test_heavy_anchors_and_large_groups(spark, documents, monkeypatch):
    """The same result if every anchor is heavy and every group too large for one suffix array."""
    monkeypatch.setattr(suffixes, "SALTS", 1)
    monkeypatch.setattr(suffixes, "HEAVY_PARTS", 10**6)
    rows = corpus(5)
    check(documents(rows, 6), rows, 24, gram=10, chunk=60)


def test_anchors_do_not_depend_on_the_buffer():
    """Equal windows have equal anchors at equal places, in buffers of any size."""
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, 300).astype(np.uint8)  # two letters: many equal grams
    alone = suffixes.pieces_of(text, np.array([0, 300]), 24, 8)
    data = np.concatenate([text, rng.integers(97, 123, 100_000).astype(np.uint8)])
    within = suffixes.pieces_of(data, np.array([0, 300, len(data)]), 24, 8)
    assert all((a == b[: len(a)]).all() for a, b in zip(alone, within, strict=True))


def test_long_texts_in_segments(monkeypatch):
    rng = random.Random(2)
    long = bytes(rng.randrange(97, 100) for _ in range(4_000))
    cut = [(tuple(parts), sum(map(len, held))) for held, parts in suffixes._segments([long, b"ab", long[:50]], 24, 500)]
    covered = set()
    for parts, _ in cut:
        for number, offset in parts:
            if number == 0:
                covered.update(range(offset, min(offset + 500, 4_000) - 23))
    assert covered == set(range(4_000 - 23))


def test_default_span_and_empty_table(spark, documents):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = letters(199), letters(200), letters(420)
    rows = [(i, letters(150) + shared[i % 3] + letters(90)) for i in range(9)]
    check(documents(rows), rows, 200)
    assert collect(documents([])) == []


def test_kept_text_keeps_whole_characters(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([("aéb", [(2, 4)]), (None, None), ("é", [(0, 1)])], "text string, s array<struct<start: long, end: long>>")
    got = [r[0] for r in frame.select(suffixes.kept_text("text", "s")).collect()]
    assert got == ["aé", None, "é"]


def test_no_file_of_a_filter_stays(spark, documents):
    folder, words = spark.sparkContext._temp_dir, " ".join(map(str, range(100)))
    docs = documents([(1, "a " + words), (2, "b " + words)])
    before = set(os.listdir(folder))
    assert suffixes.repeated_spans(docs).count() == 2
    assert set(os.listdir(folder)) <= before
