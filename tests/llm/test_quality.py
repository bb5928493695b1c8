from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np

from barrelbook.llm import quality
from barrelbook.session import shared_folder


def test_descent_reaches_the_optimum():
    """Weights of the dual descent against the sub-gradient conditions of the primal problem."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 12, 4)).astype(np.int32) for _ in range(60)]
    scale = rng.normal(size=12)
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    cost = 0.1
    best = quality.descend(rows, scale, y, cost, 400)
    x = np.zeros((60, 13))
    for i, row in enumerate(rows):
        x[i, row] = scale[row]
    x[:, 12] = 1

    def loss(w):
        return w @ w / 2 + cost * np.maximum(0, 1 - y * (x @ w)).sum()

    for _ in range(200):
        assert loss(best) <= loss(best + rng.normal(size=13) * 10 ** rng.uniform(-4, 0)) + 1e-6


def test_features_of_unusual_texts():
    shapes = quality.Shapes()
    assert len(quality.features(None, shapes)) == len(quality.features("", shapes)) == 1
    assert quality.features("A b", shapes).tolist() == quality.features("C d", shapes).tolist()
    assert quality.features("a a a", shapes).tolist() != quality.features("a b c", shapes).tolist()
    assert len(quality.features("x. " * 100_000, shapes)) < 20


def test_held_out_rows_of_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = {r.doc_id: r for r in quality.scores(docs, labels).collect()}
    assert len(found) == docs.count()
    for doc_id, row in found.items():
        assert row.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.3)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    tested = [(found[i].predicted, q) for i, q in truth.items() if found[i].held_out]
    assert np.mean([p == q for p, q in tested]) >= 0.95


def test_scores_do_not_use_held_out_labels(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    from pyspark.sql import functions as F

    wrong = F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    turned = labels.withColumn("quality", wrong)
    assert sorted(quality.scores(docs, labels).collect()) == sorted(quality.scores(docs, turned).collect())


def worded(count, seed=3):
    """Rows in like case and punctuation, whose label follows from their words alone."""
    rng = random.Random(seed)
    both = [f"word{i}" for i in range(80)]
    own = {1: ["river", "forest", "granite", "harbour"], 0: ["casino", "jackpot", "viagra", "lottery"]}
    rows = []
    for i in range(count):
        label = rng.randrange(2)
        words = [rng.choice(both) for _ in range(40)]
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(own[label]))
        rows.append((i, " ".join(words).capitalize() + ".", label))
    return rows


def test_labels_that_follow_from_words(spark, documents):
    rows = worded(800)
    labels = spark.createDataFrame([(i, label) for i, _, label in rows], "doc_id long, quality int")
    found = quality.scores(documents([(i, text) for i, text, _ in rows]), labels).collect()
    truth = {i: label for i, _, label in rows}
    tested = [r.predicted == truth[r.doc_id] for r in found if r.held_out]
    assert len(tested) > 100 and np.mean(tested) >= 0.95


def brute(rows, labels):
    """The query over lists: features, ratios, descent and curve from their definitions."""
    words = quality.Words()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known = sorted({(i, quality.all_features(t, words).tobytes(), y) for i, t in rows for j, y in labels if i == j and not held(i)})
    slots = [np.frombuffer(s, np.int32) for _, s, _ in known]
    signs = np.array([1.0 if y else -1.0 for _, _, y in known])
    good = [set(s.tolist()) for s, y in zip(slots, signs, strict=True) if y > 0]
    bad = [set(s.tolist()) for s, y in zip(slots, signs, strict=True) if y < 0]
    ratios = quality.ratios_of(slots, signs)
    used = {k for s in (*good, *bad) for k in s}
    totals = [quality.SLOTS + sum(len([k for k in s if k < quality.SLOTS]) for s in part) for part in (good, bad)]
    for k in [k for k in used if k < quality.SLOTS][:50]:
        shares = [(1 + sum(k in s for s in part)) / total for part, total in zip((good, bad), totals, strict=True)]
        assert abs(ratios[k] - np.log(shares[0] / shares[1])) < 1e-9
    model = quality.fit(slots, signs, ratios)
    scores = {}
    for i, text in rows:
        own = quality.all_features(text, words)
        z = model.slope * (sum(model.weights[k] for k in own) + model.weights[-1]) + model.shift
        scores[i] = 1 / (1 + np.exp(-z))
    return scores


def test_scores_as_by_brute_force(spark, documents):
    rows = [(i, text) for i, text, _ in worded(120, 5)] + [(500, None), (501, "")]
    labels = [(i, label) for i, _, label in worded(120, 5) if i % 3]
    expected = brute(rows, labels)
    found = quality.scores(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert abs(r.score - expected[r.doc_id]) < 1e-6 and r.predicted == (r.score >= 0.3)


def test_an_id_with_very_many_rows_teaches_once_a_text(spark, documents):
    rows = [(i, text) for i, text, _ in worded(60)]
    labels = spark.createDataFrame([(i, label) for i, _, label in worded(60)], "doc_id long, quality int")
    once = {r.doc_id: r.score for r in quality.scores(documents(rows), labels).collect()}
    often = quality.scores(documents([*rows, *[rows[7]] * 500]), labels.union(labels)).collect()
    assert len(often) == 560 and all(r.score == once[r.doc_id] for r in often)


def test_the_sample_is_bounded(spark, documents):
    rows = [(i, text) for i, text, _ in worded(60)] + [(1001, "long text " * 1000)]
    labels = spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, quality int")
    found = quality._sample(documents(rows), labels, "doc_id", "text", "quality", 20, 3000)
    sizes = {i: len(t) for i, t in rows}
    assert 1 <= found.num_rows <= 20 and sum(sizes[i] for i in found["doc_id"].to_pylist()) <= 3000


def test_edges(spark, documents, clashing):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["one", "two", "Three"]) for _ in range(20)) + ".") for i in range(60)]
    rows += [(100 + i, "BAD!! " * 12) for i in range(30)] + [(200, None), (200, None), (None, ""), (201, "w " * 50_000)]
    frame = clashing(documents(rows))
    labels = spark.createDataFrame(
        [(i, 1 if i < 100 else 0) for i, _ in rows[:90]] + [(None, 1), (7, None), (8, 5)], "doc_id long, quality int"
    )
    found = quality.scores(frame, labels).collect()
    assert len(found) == len(rows)
    assert all(r.predicted == (r.doc_id < 100) for r in found if r.doc_id is not None and r.doc_id < 200)
    assert len({r.score for r in found if r.doc_id == 200}) == 1
    assert quality.scores(documents([]), labels).collect() == []
    single = quality.scores(frame, labels.filter("quality = 1")).collect()
    assert {r.predicted for r in single} == {1}
    assert {r.score for r in quality.scores(frame, labels.limit(0)).collect()} == {0.5}


def test_every_labelled_row_teaches(spark, documents, monkeypatch):
    """Rows in many shares, a long one among them, count in the ratios, and each share in the model."""
    monkeypatch.setattr(quality, "SHARE", 60)
    rows = [(i, text) for i, text, _ in worded(800)] + [(10_001, "long text " * 5_000)]
    marks = [(i, label) for i, _, label in worded(800)] + [(10_001, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    found = quality._labelled(documents(rows), labels, "doc_id", "text", "quality").collect()
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {(r.doc_id, r.label) for r in found} == {(i, y) for i, y in marks if i not in held} and len(found) == len(rows) - len(held)
    seen = []
    monkeypatch.setattr(quality, "_ratios", lambda counts, real=quality._ratios: seen.append(counts) or real(counts))
    model = quality.train(documents(rows), labels)
    signs = np.array([1.0 if r.label else -1.0 for r in found])
    slots = [np.frombuffer(r.slots, np.int32) for r in found]
    want = np.zeros((2, quality.ALL_SLOTS))
    for row, sign in zip(slots, signs, strict=True):
        want[int(sign > 0), row] += 1
    assert len(seen) == 1 and (seen[0] == want).all()
    truth, words = dict(marks), quality.Words()
    right = [(model.score(quality.all_features(t, words)) >= 0.3) == truth[i] for i, t in rows if i in held]
    assert len(right) > 100 and np.mean(right) >= 0.95


def test_packed_slots():
    words = quality.Words()
    for text in (None, "", "a", "One two, three 4. " * 50, " ".join(f"word{i}" for i in range(200_000))):
        slots = quality.all_features(text, words)
        assert (quality._unpack(quality._pack(slots)) == slots).all() and quality._unpack(quality._pack(slots)).dtype == np.int32
    edges = np.array([0, 1, 255, 256, 65_536, quality.ALL_SLOTS - 1], dtype=np.int32)
    assert (quality._unpack(quality._pack(edges)) == edges).all()


def test_learning_writes_less_than_the_texts(spark, documents):
    """Shuffles and stored rows take less disk than the texts, of which a part has labels."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(20_000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=500))) for i in range(4_000)]
    docs = documents(rows).localCheckpoint()
    labels = spark.createDataFrame([(i, i // 5 % 2) for i in range(0, 4_000, 5)], "doc_id long, quality int")
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        shuffled = {Path(f.getPath()) for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())}
        stored = set(Path(shared_folder(spark).removeprefix("file:")).rglob("part-*"))
        return {f: f.stat().st_size for f in shuffled | stored if f.is_file()}

    before = files()
    quality.train(docs, labels)
    written = sum(size for f, size in files().items() if f not in before)
    assert 0 < written < 0.6 * sum(len(t) for _, t in rows), written


def test_a_full_set_loses_no_row(spark, documents, monkeypatch):
    """With sets of several buckets, and with one that every row is in, the labelled rows come out alone and whole."""
    rows = [(i, text) for i, text, _ in worded(400)] + [(7, "another text"), (7, None), (None, "x")]
    marks = [(i, label) for i, _, label in worded(400) if i % 2] + [(9, 0), (9, 1), (10_000, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    texts, words = {}, quality.Words()
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    want = {(i, y, quality.all_features(t, words).tobytes()) for i, y in marks if i not in held for t in texts.get(i, [])}
    monkeypatch.setattr(quality, "ROW_BITS", 1 << 12)
    for full in (False, True):
        if full:
            monkeypatch.setattr(quality, "_set_of", lambda known, real=quality._set_of: real(known) | np.uint8(255))
        found = quality._labelled(documents(rows * 2), labels, "doc_id", "text", "quality").collect()
        assert {(r.doc_id, r.label, r.slots) for r in found} == want and len(found) == len(want)
