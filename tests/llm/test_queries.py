"""The registered queries: those with SQL against it, the others against brute force."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter

import pytest

from barrelbook.llm.queries import ORACLES, REGISTRY
from tests.compare import connect, difference

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, connection, name):
    assert difference(REGISTRY[name](spark, FOLDER), connection, ORACLES[name]) is None


@pytest.fixture(scope="module")
def texts(connection):
    return dict(connection.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def test_packing_query(spark, texts):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    rows = REGISTRY["op3_packing"](spark, FOLDER).collect()
    tokens, sequences = Counter(), Counter()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        tokens[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert tokens == {d: len(x) for d, x in ids.items()}
    assert all(n == 1024 or n & (n - 1) == 0 and n < 1024 for n in sequences.values())


def test_simhash_query(spark, texts):
    from tests.llm.test_simhash import brute_classes, brute_print

    ids = sorted(texts)
    prints = [brute_print(texts[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, brute_classes(prints))}
    rows = REGISTRY["op4_simhash"](spark, FOLDER).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want


def test_suffix_query(spark, texts):
    ids = sorted(texts)
    data = [texts[i].encode() for i in ids]
    starts = Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    want = {}
    for doc_id, text in zip(ids, data):
        gone = bytearray(len(text))
        for i in range(len(text) - 199):
            if starts[text[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(text, gone) if not g)
        want[doc_id] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    rows = REGISTRY["op8_suffix_dedup"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_quality_query(spark, connection):
    found = {r.doc_id: r for r in REGISTRY["op5_quality"](spark, FOLDER).collect()}
    labels = connection.execute("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL").fetchall()
    tested = [found[i].predicted == q for i, q in labels if found[i].held_out]
    assert sum(tested) >= 0.95 * len(tested)


def test_url_query(spark, connection):
    from tests.llm.test_urls import brute

    rows = connection.execute("SELECT page_id, url FROM pages").fetchall()
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in REGISTRY["op9_url_filter"](spark, FOLDER).collect()}
    assert found == {r[0]: r[1:5] for r in brute(rows)}


def test_archive_query(spark, connection):
    from tests.llm.test_archives import brute, rows_of

    rows = connection.execute("SELECT page_id, url, html FROM pages").fetchall()
    assert rows_of(REGISTRY["op10_archives"](spark, FOLDER)) == brute(rows)


def test_main_text_query(spark, connection):
    rows = REGISTRY["op1_main_text"](spark, FOLDER).collect()
    assert len(rows) == connection.execute("SELECT count(*) FROM pages").fetchone()[0]
    assert all(r.n_chars == len(r.text) and "<" not in r.text for r in rows)
