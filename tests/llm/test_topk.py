from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from barrelbook.llm import topk


def brute(rows, is_query, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    out = []
    for query in sorted({i for i, _ in usable if is_query(i)}):
        own = min(v for i, v in usable if i == query)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != query)
        out += [(query, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def check(spark, rows, k=5, block=3, every=5, **extra):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    for name in extra:
        frame = frame.withColumn(name, F.lit(extra[name]))
    found = topk.top_k(frame, F.col("vec_id") % every == 0, k=k, block=block)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    # ranks of equal rows are interchangeable
    assert got == sorted(brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % every == 0, k))


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 6) / 4).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(12)]  # many ties
    rows += [(200, None), (205, [1.0, None]), (210, [float("nan")]), (215, [float("inf"), 1.0]), (220, []), (225, [0.5])]
    rows += [(None, [1.0] * 6), (20, rows[20][1]), (7, rows[7][1]), (-10, [0.1] * 6)]
    check(spark, rows, score="x", rank=1, v="y", low=0)


def test_few_rows_and_empty_table(spark):
    check(spark, [(0, [1.0]), (1, [2.0])])
    check(spark, [(0, [1.0])])
    check(spark, [])


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0**20 + i, -(2.0**21), 3.0]) for i in range(12)]
    check(spark, rows)


def test_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found = topk.top_k(table, F.col("vec_id") % 50 == 0)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert got == sorted(brute(rows, lambda i: i % 50 == 0, 5))


def test_the_best_is_found_whatever_its_size(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 0.0]), (3, [1e11, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(frame, F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(3, 256 * 256 * 10**11), (1, 2**15), (2, 2**14)]


def test_large_components_beside_small_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 2.0 ** rng.choice([0, 1, 20, 40], size=4)).tolist()) for i in range(80)]
    rows = [(i, [min(max(x, -4.0), 4.0) if i % 5 == 0 else x for x in v]) for i, v in rows]  # the scores fit 64 bits
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = topk.top_k(frame, F.col("vec_id") % 5 == 0, block=7)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert got == sorted(brute(rows, lambda i: i % 5 == 0, 5))
    assert max(abs(s) for *_, s in got) > 1 << 53


def test_scores_beyond_64_bits_count_as_the_ends(spark):
    rows = [(0, [1e300]), (1, [1e300]), (2, [-1e300]), (3, [1.0]), (4, [0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(topk.top_k(frame, F.col("vec_id") == 0).collect(), key=lambda r: r["rank"])
    most = (1 << 63) - 1
    assert [(r.vec_id, r.score) for r in found] == [(1, most), (3, most), (4, 0), (2, -most)]
