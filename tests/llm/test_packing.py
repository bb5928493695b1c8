from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barrelbook.llm import packing, queries

MAKE = packing.byte_pair_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
QUERY_ENCODER = queries.encoder()()


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encode():
    return MAKE()


@given(text=st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_ids_equal_those_of_the_tokenizer(reference, encode, text):
    assert list(encode(text)) == reference(text)


ADDED = "<|endoftext|>"


@given(parts=st.lists(st.sampled_from([ADDED, ADDED[:-1], ADDED[2:], " ", "\n", "a", "end.", "Next", "\u00df"]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_ids_of_added_tokens(reference, parts):
    text = "".join(parts)
    assert list(QUERY_ENCODER(text)) == reference(text)


def test_pieces_of_texts_with_added_tokens(spark, documents, reference):
    texts = {1: f"end.{ADDED}Next", 2: ADDED, 3: f"{ADDED}{ADDED} x"}
    pieces = queries.piece_digests(documents(list(texts.items()))).collect()
    whole = {i: [*reference(text), 0] for i, text in texts.items()}
    assert whole[1] == [437, 13, 50256, 10019, 0]
    assert {p.doc_id: p.doc_tokens for p in pieces} == {i: len(ids) for i, ids in whole.items()}
    for p in pieces:
        ids = np.array(whole[p.doc_id][p.start : p.start + p.length], "<u4")
        assert p.ids_crc32 == zlib.crc32(ids.tobytes())


def test_ids_of_given_documents(spark, reference, encode):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    for (text,) in rows:
        assert list(encode(text or "")) == reference(text or "")


def checked(sizes, window=16, limit=5):
    packer = packing.Packer(window, limit)
    for number, size in enumerate(sizes):
        packer.add(number, np.arange(size, dtype="<u4") + 1000 * number)
    packer.close()
    seen = defaultdict(list)
    for held in packer.done:
        size = sum(len(p[2]) for p in held)
        assert size == window or size & (size - 1) == 0 and 0 < size < window
        for doc, start, ids in held:
            assert list(ids) == list(range(1000 * doc + start, 1000 * doc + start + len(ids)))
            seen[doc] += range(start, start + len(ids))
    assert {d: sorted(x) for d, x in seen.items()} == {d: list(range(s)) for d, s in enumerate(sizes) if s}
    return packer.done


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=200, deadline=None)
def test_every_token_once_without_padding(sizes):
    partial = [h for h in checked(sizes) if sum(len(p[2]) for p in h) < 16]
    assert len(partial) <= 4 * (1 + len(sizes) // 5)


def test_level_with_the_least_sum_of_squares():
    """Against the definition: try every level, count squares."""
    rng = np.random.default_rng(5)
    packer = packing.Packer(12, 10**6)
    for number in range(300):
        size = int(rng.integers(1, 12))
        before = packer.counts.copy()
        options = {}
        for level in [0, *np.flatnonzero(before[:12])]:
            if level + size <= 12:
                after = before.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 12
                options[int(level)] = int((after[1:12] ** 2).sum())
        best = max(level for level, cost in options.items() if cost == min(options.values()))
        packer.add(number, np.zeros(size, "<u4"))
        after = before.copy()
        after[best] -= best > 0
        after[best + size] += best + size < 12
        assert (packer.counts[:12] == after[:12]).all()


def test_pieces_of_documents(spark, documents, clashing, reference):
    rows = [(0, None), (1, ""), (2, "a b"), (2, "a b"), (None, "x"), (3, "word " * 5_000), (4, "ß" * 3_000)]
    rows += [(i, f"text {i} " * (i % 70)) for i in range(10, 120)]
    pieces = packing.pack(clashing(documents(rows)), MAKE).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.length * 4 == len(p.ids)
    for doc_id, text in dict(rows).items():
        whole = [*reference(text or ""), 0]
        copies = 2 if doc_id == 2 else 1
        found = sorted(by_doc[doc_id], key=lambda p: p.start)
        assert sum(p.length for p in found) == copies * len(whole)
        assert {p.doc_tokens for p in found} == {len(whole)}
        for p in found:
            assert list(np.frombuffer(p.ids, "<u4")) == whole[p.start : p.start + p.length]
    for held in by_sequence.values():
        held.sort(key=lambda p: p.offset)
        assert [p.offset for p in held] == list(np.cumsum([0, *(p.length for p in held)])[:-1])
        size = sum(p.length for p in held)
        assert {p.sequence_tokens for p in held} == {size}
        assert size == 1024 or size & (size - 1) == 0 and size < 1024
    assert packing.pack(documents([]), MAKE).collect() == []


@pytest.mark.parametrize("run", [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "\t" * 2_000_000 + "x", "w \n" * 10 + " \n" * 200_000 + "end"])
def test_very_long_runs_of_white_space(spark, documents, reference, run):
    ids = reference(run)
    assert QUERY_ENCODER(run).tolist() == ids
    rows = packing.pack(documents([(1, run), (2, "a b")], 1), queries.encoder()).collect()
    pieces = sorted((r.start, r.ids) for r in rows if r.doc_id == 1)
    found = np.concatenate([np.frombuffer(i, "<u4") for _, i in pieces])
    assert found.tolist() == [*ids, 0]
