from __future__ import annotations

import collections
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barrelbook.llm import latent


def brute_chunk(texts, items):
    """(text, passage start, unit weights on the items' words) of every passage, from scratch."""
    out = []
    for number, text in enumerate(texts):
        words = latent.words_of(text)
        step = latent.BLOCK_WORDS
        starts = list(range(0, max(1, len(words) - step), step)) if words else []
        for start in starts:
            out.append((number, start, words[start : start + 2 * step]))
    return out


def test_passages_and_their_terms():
    rng = random.Random(1)
    vocabulary = {f"w{i}".encode(): i for i in range(30)}
    texts = [None, "", "w1", " ".join(f"w{rng.randrange(45)}" for _ in range(16)), " ".join(f"w{rng.randrange(45)}" for _ in range(17))]
    texts += [" ".join(f"w{rng.randrange(45)}" for _ in range(n)) for n in (32, 33, 100)]
    (chunk,) = latent._chunks(texts, vocabulary)
    want = brute_chunk(texts, None)
    assert len(chunk.passages) == len(want)
    pairs = list(zip(*chunk.pairs()))
    others = chunk.both(chunk.others)
    for place, (passage, (number, start, words)) in enumerate(zip(chunk.passages, want)):
        known = sorted({vocabulary[w] for w in words if w in vocabulary})
        assert chunk.docs[passage] == number
        assert list(chunk.passage_terms(passage)) == known
        assert sorted(t for p, t in pairs if p == passage) == known
        assert others[place] == sum(w not in vocabulary for w in words)


def test_space_is_that_of_a_full_decomposition(spark):
    """Against numpy's SVD of the stacked matrix."""
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 40)) + 0.01 * rng.normal(size=(300, 40))
    items = rng.normal(size=(3, 4)) @ rng.normal(size=(4, 40))
    terms = np.arange(40, dtype="<i4").tobytes()
    frame = spark.createDataFrame([(terms, r.astype("<f4").tobytes()) for r in rows], "terms binary, x binary").repartition(4)
    basis = latent.latent_space(frame, items, 7)
    full = np.linalg.svd(np.r_[rows, np.sqrt(latent.ITEM_WEIGHT) * items])[2][:7].T
    assert np.allclose(basis.T @ basis, np.eye(7), atol=1e-8)
    assert np.linalg.svd(basis.T @ full)[1].min() > 0.999


@pytest.mark.parametrize(
    ("text", "answer"),
    [("What is the capital of that land? The city of stone", "the city of stone"), ("Q one two. Answer: a b c", "a b c"), ("First words here. Then the last one.", "then the last one"), ("a b c d e f g h", "g h")],
)
def test_answers(text, answer):
    assert latent.words_of(text)[latent.answer_at(text) :] == answer.encode().split()


def corpus():
    rng = random.Random(6)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randrange(12, 60)).capitalize() + ". " + text(6)) for i in range(40)] + [(None, text(30)), (98, None), (99, "")]
    docs, planted = [], set()
    for i in range(240):
        parts = [text(rng.randrange(0, 200))]
        if i % 6 == 0:
            number = rng.randrange(40)
            words = items[number][1].split()
            if i % 12 == 0:  # reworded: one word in nine changed, some swapped case and punctuation
                words = [word() if rng.random() < 0.11 else w.upper() + "," for w in words]
            parts += [" ".join(words), text(rng.randrange(0, 60))]
            planted.add((i, number))
        docs.append((i, "\n".join(parts)))
    return docs, items, planted


def test_leaks_are_found_and_clean_documents_are_not(spark, documents, clashing):
    docs, items, planted = corpus()
    extra = [(500, None), (501, ""), (502, docs[0][1]), (502, docs[0][1]), (None, docs[6][1]), (503, "la " * 40_000)]
    frame = clashing(documents(docs + extra, 4))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    for block in (4_096, 7):  # the same with several passes
        rows = latent.leaks(frame, benchmark, sample_docs=50, item_block=block).collect()
        found = {(r.doc_id, r.item_id) for r in rows if r.doc_id is not None and r.doc_id < 500}
        assert found <= planted
        assert len(found) >= 0.97 * len(planted)
        number = {i: n for i, n in planted}
        assert [r.item_id for r in rows if r.doc_id == 502] == [number[0]] * 2
        assert [r.item_id for r in rows if r.doc_id is None] == [number[6]]
        assert not [r for r in rows if r.doc_id in (500, 501, 503)]
        for r in rows:
            assert 0 <= r.first_word < r.end_word and r.shared >= 0.6 and r.answer >= 0.6


def test_no_candidate_is_passed_over():
    """The bound on what terms can add loses nothing against cosines of all passages."""
    rng = np.random.default_rng(7)
    vocabulary = {f"w{i}".encode(): i for i in range(60)}
    weights = np.r_[rng.uniform(1, 9, 60), 9.0]
    rows = np.zeros((8, 60))
    for row in rows:
        row[rng.integers(0, 60, 9)] = 1
    rows *= weights[:-1]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    space = latent._space(weights, np.linalg.qr(rng.normal(size=(60, 12)))[0], rows)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 75, n)) for n in (5, 16, 40, 300)]
    (chunk,) = latent._chunks(texts, vocabulary)
    want = set()
    for place, passage in enumerate(chunk.passages):
        terms = chunk.passage_terms(passage)
        x = weights[terms]
        rest = chunk.both(chunk.others)[place] * weights[-1] ** 2
        cosines = space.items @ (x @ space.basis[terms]) / np.sqrt(x @ x + rest)
        want |= {(int(passage), int(i)) for i in np.flatnonzero(cosines >= 0.2)}
    assert want and {c[:2] for c in latent.candidates(chunk, space, 0.2)} == want


def test_candidates_against_brute_force(spark):
    """Recall of the latent search against exact TF-IDF cosines on given documents."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in latent.leaks(docs, items).collect()}
    whole = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in (d.text or "")}
    assert len(whole & found) >= 0.98 * len(whole) and len(whole) > 10


def many_items(count=1_200, docs=360):
    """Short and long items, and documents that hold some of them whole or reworded among other words."""
    rng = random.Random(9)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    common = [word() for _ in range(40)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 8, 20, 70])) + ". " + text(4)) for i in range(count)]
    rows = []
    for i in range(docs):
        words = items[rng.randrange(count)][1].split()
        if i % 2:
            words = [f"z{rng.randrange(10**6)}" if rng.random() < 0.2 else w.upper() + "," for w in words]
        if i % 4 == 1:
            words.insert(rng.randrange(len(words)), "y y y")
        around = lambda n: " ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.7 else text(1) for _ in range(n))
        rows.append((i, f"{around(rng.randrange(80))} {' '.join(words)} {around(rng.randrange(80))}"))
    return rows, items


def in_order(docs, items):
    """All pairs that pass the checks over whole documents, without any search."""
    held = [(i, words, collections.Counter(words), latent.answer_at(t)) for i, t in items for words in [latent.words_of(t)]]
    found = set()
    for doc, text in docs:
        around = latent.words_of(text)
        there = collections.Counter(around)
        for item, words, counts, answer in held:
            if sum(min(n, there[w]) for w, n in counts.items()) >= 0.6 * len(words):
                share, answered, *_ = latent.verified(words, answer, around)
                if share >= 0.6 and answered >= 0.6:
                    found.add((doc, item))
    return found


@pytest.mark.parametrize("block", [4_096, 500])
def test_whatever_passes_the_checks_is_found(spark, documents, block):
    docs, items = many_items()
    want = in_order(docs, items)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = latent.leaks(documents(docs), benchmark, sample_docs=50, item_block=block).collect()
    assert len(want) > 300 and want <= {(r.doc_id, r.item_id) for r in rows}
    assert all(r.shared >= 0.6 and r.answer >= 0.6 and 0 <= r.first_word < r.end_word for r in rows)
    texts = dict(docs)
    for r in rows:  # the stretch holds that share of the item
        words = latent.words_of(items[r.item_id][1])
        part = latent.words_of(texts[r.doc_id])[r.first_word : r.end_word]
        assert len(latent.aligned(part, words)) >= round(r.shared * len(words))


def test_empty_tables(spark, documents):
    benchmark = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert latent.leaks(documents([]), benchmark).collect() == []
    assert latent.leaks(documents([(1, "one two three four five six")]), benchmark.limit(0)).collect() == []
    assert len(latent.leaks(documents([(1, "x one two three four five six")]), benchmark).collect()) == 1


def test_sums_of_passages_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    vocabulary = {f"w{i}".encode(): i for i in range(30)}
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 40, n)) for n in (3, 200, 16, 17, 700)]
    values = rng.random((30, 5))
    (chunk,) = latent._chunks(texts, vocabulary)
    monkeypatch.setattr(latent, "SUMMED", 7)
    want = []
    for passage in chunk.passages:
        terms = [t for b, t in zip(chunk.blocks, chunk.terms) if b == passage or (b == passage + 1 and not chunk.single[passage])]
        want.append(values[terms].sum(axis=0).max(initial=0) if terms else 0)
    assert np.allclose(chunk.most(values), want)


def test_all_documents_shape_the_space(spark, documents, monkeypatch):
    """Counts of blocks in which terms meet, in small parts, against a loop over all texts."""
    rng = random.Random(4)
    items = [(1, " ".join(f"w{i}" for i in range(30)))]
    texts = [" ".join(f"w{rng.randrange(45)}" for _ in range(rng.randrange(0, 90))) for _ in range(200)]
    block = next(latent._item_blocks(spark.createDataFrame(items, "item_id long, text string"), 10, 100))
    number, size = block.vocabulary, len(block.vocabulary)
    want, passages = np.zeros((size, size)), np.zeros(size)
    for text in texts:
        words = latent.words_of(text)
        for begin in range(0, len(words), latent.BLOCK_WORDS):
            terms = sorted({number[w] for w in words[begin : begin + latent.BLOCK_WORDS] if w in number})
            want[np.ix_(terms, terms)] += 1
    for _, _, words in brute_chunk(texts, items):
        passages[sorted({number[w] for w in words if w in number})] += 1
    for name, value in (("PENDING", 50), ("HELD", 20), ("PARTS", 7), ("CHUNK_WORDS", 100)):
        monkeypatch.setattr(latent, name, value)
    bounds = latent._bounds(size)
    shared = type("Shared", (), {"value": block})()
    frame = documents(list(enumerate(texts)), 4).selectExpr("text", "true AS fitted").toArrow().to_batches()
    sums = [b for f in frame for b in latent._counted(shared, bounds)(iter([f]))]
    assert len(sums) > 10  # sent on some at a time
    found = np.zeros((size, size))
    for batch in latent._added_up(iter(sums)):
        for part, keys, values in latent._unpacked(batch):
            if part >= 0:
                found.reshape(-1)[keys] = values
            else:
                assert values[keys == -1][0] == len(brute_chunk(texts, items))
                assert [values[keys == i].sum() for i in range(size)] == passages.tolist()
                assert [values[keys == size + i].sum() for i in range(size)] == np.diag(want).tolist()
    assert (found == np.triu(want)).all()


def test_rare_documents_shape_the_space_too(spark, documents):
    """Three documents of 6,000 tell that two words meet. A fit on 2,000 documents would mostly miss some."""
    rows = [(i, "plain words here and nothing of note in it") for i in range(6_000)]
    rows += [(10_000 + i, "zinc " * 8 + "lead " * 8) for i in range(3)]
    seen = {}

    def leading(met, weights, items, rank):
        for batch in met.toArrow().to_batches():
            for part, keys, values in latent._unpacked(batch):
                if part >= 0:
                    seen.update(zip(keys.tolist(), values.tolist()))
        return np.eye(items.shape[1])

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(latent, "_leading", leading)
        benchmark = spark.createDataFrame([(1, "zinc lead words")], "item_id long, text string")
        latent.leaks(documents(rows), benchmark).collect()
    assert seen == {0: 3, 1: 3, 4: 3, 8: 6_000}


def test_shares_of_verified_stretches():
    """Lengths of common subsequences by bits, against the table of them."""
    rng = random.Random(8)
    for _ in range(300):
        words = [rng.randrange(9) for _ in range(rng.randrange(1, 20))]
        around = [rng.randrange(11) for _ in range(rng.randrange(0, 40))]
        table = np.zeros((len(words) + 1, len(around) + 1), dtype=int)
        for i, a in enumerate(words):
            for j, b in enumerate(around):
                table[i + 1, j + 1] = table[i, j] + 1 if a == b else max(table[i, j + 1], table[i + 1, j])
        assert latent._in_order(latent._places(words), len(words), around) == table[-1, -1]


def test_rows_of_a_product_come_from_one_task(spark, monkeypatch):
    """What tasks send for a product is as large as the product, however many tasks there are."""
    size, width, sent = 600, 8 + latent.EXTRA, spark.sparkContext.accumulator(0)
    rng = np.random.default_rng(3)
    terms = [np.sort(rng.choice(size, 40, replace=False)) for _ in range(400)]
    packed = [(t.astype("<i4").tobytes(), rng.normal(size=40).astype("<f4").tobytes()) for t in terms]
    frame = spark.createDataFrame(packed, "terms binary, x binary").repartition(8)
    product = latent._product

    def counting(*given):
        def run(batches):
            for batch in product(*given)(batches):
                sent.add(sum(len(x) for x in batch.column("sums").to_pylist()))
                yield batch

        return run

    monkeypatch.setattr(latent, "_product", counting)
    latent.latent_space(frame, rng.normal(size=(5, size)), 8)
    assert 0 < sent.value <= (latent.POWERS + 1) * size * width * 8


def test_no_file_of_a_broadcast_stays(spark, documents):
    folder = spark.sparkContext._temp_dir
    docs, benchmark = documents([(1, "x one two three four five six")]), [(1, "one two three four five six"), (2, "seven eight nine")]
    before = set(os.listdir(folder))
    assert latent.leaks(docs, spark.createDataFrame(benchmark, "item_id long, text string"), item_block=1).count() == 1
    assert set(os.listdir(folder)) <= before
