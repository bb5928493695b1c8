from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from barrelbook.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return Counter(TERM.findall(lowered))


def expected(docs, items, k=10):
    counts = [(doc_id, terms(text)) for doc_id, text in docs]
    counts = [(doc_id, c) for doc_id, c in counts if c]
    total, number = sum(c.total() for _, c in counts), len(counts)
    df = Counter(t for _, c in counts for t in c)
    found = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counts:
            m = 25 + 75 * c.total() * number // total
            score = 0
            for term, times in terms(text).items():
                if term in c:
                    w = math.floor(1000 * math.log((2 * number + 2) / (2 * df[term] + 1)))
                    score += times * w * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:k], 1):
            found.append((item_id, rank, doc_id, -score))
    return sorted(found, key=str)


def made(seed, docs=400, items=30, words=120):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" if i % 3 else f"É{i}x" for i in range(words)]

    def text(n):
        return " ".join(vocabulary[int(words * pick.random() ** 2)] for _ in range(n))

    rows = [(i, text(pick.choice([1, 5, 20, 60]))) for i in range(docs)]
    rows += [(None, rows[3][1]), (5, rows[5][1]), (9000, None), (9001, ""), (9002, "-- . !"), (9003, "W1 w1\x7fw1_é1X" * 50)]
    rows += [(10_000 + i, rows[7][1]) for i in range(60)]  # many equal scores
    asked = [(i, text(pick.choice([1, 3, 12]))) for i in range(items)]
    asked += [(items, None), (items + 1, "nowhere"), (2, asked[2][1]), (None, asked[0][1])]
    return rows, asked


def frames(spark, docs, items, parts=4):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(parts),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def result(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


@pytest.mark.parametrize("block", [1024, 9])
def test_best_documents_as_by_brute_force(spark, block):
    docs, items = made(1)
    assert result(lexical.ranked(*frames(spark, docs, items), block=block)) == expected(docs, items)


def test_small_batches_and_a_sample_give_the_same(spark, monkeypatch):
    docs, items = made(2)
    for name, value in {"BATCH": 64, "SAMPLE": 40, "PART": 16}.items():
        monkeypatch.setattr(lexical, name, value)
    assert result(lexical.ranked(*frames(spark, docs, items), k=4)) == expected(docs, items, 4)


def test_pruning_leaves_out_most_pairs_and_no_result():
    """Topics that share no words: whole batches of other topics are never scored."""
    pick = random.Random(3)
    items = [{10 * (i % 40) + j: 1000 for j in range(10)} for i in range(80)]
    weights = np.full(400, 1000, np.int64)
    ids = np.arange(4000)
    rows = [sorted(pick.sample(range(10 * (i % 40), 10 * (i % 40) + 10), 5)) for i in range(4000)]
    columns = np.concatenate([np.array(r) for r in rows])
    values = np.array([pick.randint(1, 99) for _ in columns])
    documents = lexical.DocumentTree(ids, np.arange(0, 5 * 4001, 5), columns, values, weights)
    tree = lexical.ItemTree(items)
    best = lexical.Best(80, 5, np.ones(80, np.int64))
    scored = 0
    own = documents.scores

    def counted(leaves, dense):
        nonlocal scored
        scored += len(leaves) * len(dense)
        return own(leaves, dense)

    documents.scores = counted
    lexical.search(documents, tree, best, 400)
    assert scored < 80 * len(documents.levels[-1]) / 5
    matrix = np.zeros((4000, 400), np.int64)
    matrix[np.repeat(ids, 5), columns] = values
    for at, item in enumerate(tree.order):
        scores = matrix[:, list(items[item])].sum(axis=1) * 1000
        first = np.lexsort((ids, -scores))[:5]
        assert best.ids[at].tolist() == first.tolist() and best.scores[at].tolist() == scores[first].tolist()


def test_empty_tables(spark):
    docs, items = made(1, 10, 3)
    assert result(lexical.ranked(*frames(spark, [], items))) == []
    assert result(lexical.ranked(*frames(spark, docs, []))) == []
    assert result(lexical.ranked(*frames(spark, docs, [(1, ".,;")]))) == []


def test_long_text_and_clashing_columns(spark, clashing):
    docs = [(1, "alpha beta " * 500_000), (2, "alpha"), (3, "x" * 3_000_000 + " beta")]
    docs_frame, items_frame = frames(spark, docs, [(1, "Alpha BETA")])
    assert result(lexical.ranked(clashing(docs_frame), clashing(items_frame))) == expected(docs, [(1, "Alpha BETA")])
