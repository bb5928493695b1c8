from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barrelbook.llm import latent, quality, stages
from tests.llm.test_simhash import brute_classes, brute_print
from tests.llm.test_suffixes import brute_spans

FOLDER = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_every_stage_on_given_documents(spark, table):
    """Each stage against brute force on what its predecessor kept, down to the packed tokens."""
    columns = table.columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    accepted = {r.doc_id for r in quality.scores(table, labels).collect() if r.predicted == 1}
    good = stages.quality_filter(spark, table, FOLDER)
    assert good.columns == columns
    assert rows_of(good) == rows_of(table.filter(F.col("doc_id").isin(sorted(accepted))))

    texts = {r.doc_id: r.text or "" for r in good.collect()}
    ids = sorted(texts)
    classes = brute_classes([brute_print(texts[i]) for i in ids])
    single = stages.near_duplicates(spark, good, FOLDER)
    assert single.columns == columns
    first = {ids[c] for c in classes}
    assert rows_of(single) == rows_of(good.filter(F.col("doc_id").isin(sorted(first))))

    ids = sorted(first)
    data = [texts[i].encode() for i in ids]
    cut = stages.repeats(spark, single, FOLDER)
    assert cut.columns == columns
    for row, spans in zip(sorted(cut.collect()), brute_spans(data, 200)):
        text = data[ids.index(row.doc_id)]
        gone = {x for s, e in spans for x in range(s, e)}
        kept = bytes(b for i, b in enumerate(text) if i not in gone)
        assert row.text.encode().replace(kept, b"", 1) in (b"",) or len(row.text.encode()) - len(kept) <= 6 * len(spans)
        assert row.n_chars == len(row.text)

    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    held = {r.doc_id for r in latent.leaks(cut, benchmark).collect()}
    clean = stages.decontamination(spark, cut, FOLDER)
    assert clean.columns == columns
    assert rows_of(clean) == rows_of(cut.filter(~F.col("doc_id").isin(sorted(held) or [-1])))
    items = [r.text for r in benchmark.collect()]
    assert not [r for r in clean.collect() if any(i in r.text for i in items)]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean.collect()}
    assert_packed(corpus_pipeline.run(spark, FOLDER).collect(), sizes)


def assert_packed(pieces, sizes):
    tokens, sequences = Counter(), Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
        sequences[p.sequence_id] += p.length
        assert p.doc_tokens == sizes[p.doc_id]
    assert dict(tokens) == sizes
    assert all(n == 1024 or n & (n - 1) == 0 and n < 1024 for n in sequences.values())


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing",
    ]


@pytest.mark.parametrize("number", range(5))
def test_edges(spark, documents, clashing, number):
    """NULLs, empty and long texts, repeated rows and clashing names in every stage."""
    stage = corpus_pipeline.STAGES[number][1]
    rows = [(1, "A plain sentence of words, said once."), (1, "A plain sentence of words, said once."), (2, None), (3, "")]
    rows += [(None, "Some other text without any id at all."), (None, None), (4, "word " * 30_000)]
    frame = clashing(documents(rows))
    found = stage(spark, frame, FOLDER)
    got = found.collect()
    if number < 4:
        assert found.columns == frame.columns
        assert len(got) <= len(rows)
    if number == 1:
        kept = defaultdict(int)
        for r in got:
            kept[r.doc_id] += 1
        assert kept == {1: 1, 2: 1, None: 1, 4: 1}  # 2, 3 and the NULL text without id are one component
    if number == 3:
        assert len(got) == len(rows)
    assert stage(spark, clashing(documents([])), FOLDER).collect() == []
