"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size against all candidates. For a block, every score is
computed and counted into bins; global counts locate the bin that holds each query's kth best
score, and the next round counts that bin with finer ones, until bins are single scores. A last
pass keeps what lies above the kth score, and the smallest ids among its ties.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barrelbook.session import scratch_path

#: Queries of one block; this many vectors are sent to every executor at a time.
BLOCK = 16_384
#: Scores computed at once by a task.
TILE = 1 << 21
#: Every round splits the bin that holds the kth score into this many powers of two.
ROUND_BITS = 10
SCALE = 256
#: Below every score; the lowest score that is told from it.
_LOW, _LEAST = np.iinfo(np.int64).min, np.iinfo(np.int64).min + 1
_MOST = np.iinfo(np.int64).max


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)`` with ``floor(scale * x)`` of every component, without unusable vectors.

    ``scale`` is a power of two. The whole numbers are kept as doubles, which hold them exactly: from
    2^53 on every double is a whole number.
    """

    def whole(x: Column) -> Column:
        scaled = F.least(F.greatest(x.cast("double") * scale, F.lit(-sys.float_info.max)), F.lit(sys.float_info.max))
        return F.when(F.abs(scaled) < float(1 << 53), F.floor(scaled).cast("double")).otherwise(scaled)

    usable = F.col(vector).isNotNull() & F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return vectors.filter(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, whole).alias("v"))


def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of a list column, cut or filled with zeros to ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0)) if width is None else width
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = places < width
    out[rows[inside], places[inside]] = flat[inside]
    return out


def _large(rows: np.ndarray) -> np.ndarray:
    """Rows with components so large that sums of products may not be exact in doubles."""
    limit = math.isqrt((1 << 53) // max(1, rows.shape[1]))
    return np.abs(rows).max(axis=1, initial=0) >= limit


def _exact(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Products in whole numbers of any length; what a 64-bit integer can't hold counts as its end."""
    left, right = (np.array([[int(x) for x in row] for row in rows.tolist()], dtype=object) for rows in (queries, candidates))
    products = left.reshape(queries.shape) @ right.reshape(candidates.shape).T
    return np.array([[min(max(x, _LEAST), _MOST) for x in row] for row in products], dtype=np.int64).reshape(products.shape)


def _products(queries: np.ndarray, candidates: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles, exact for rows of ordinary size, and for ``large`` queries
    and candidates one by one in whole numbers, so that a few of them slow down no other."""
    odd = _large(candidates)
    if not large.any() and not odd.any():
        return (queries @ candidates.T).astype(np.int64)
    scores = np.empty((len(queries), len(candidates)), dtype=np.int64)
    scores[np.ix_(~large, ~odd)] = queries[~large] @ candidates[~odd].T
    scores[large] = _exact(queries[large], candidates)
    scores[np.ix_(~large, odd)] = _exact(queries[~large], candidates[odd])
    return scores


class Block:
    """Queries of one pass, and for each the lowest score that can still be among its best."""

    def __init__(self, ids: list[int], vectors: list[list[int]]):
        self.ids = np.array(ids, dtype=np.int64)
        self.vectors = _matrix(pa.array(vectors, pa.list_(pa.float64())))
        self.large = _large(self.vectors)
        self.low = np.full(len(ids), _LEAST)

    def tiles(self, batches: Iterator[pa.RecordBatch]):
        """Scores tile by tile; a query's own row scores below everything."""
        for batch in batches:
            missing = batch.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False)[~missing]
            candidates = _matrix(batch.column("v"), self.vectors.shape[1])[~missing]
            if len(ids) == 0:
                continue
            step = max(1, TILE // len(ids))
            for start in range(0, len(self.ids), step):
                scores = _products(self.vectors[start : start + step], candidates, self.large[start : start + step])
                scores[self.ids[start : start + step, None] == ids[None, :]] = _LOW
                yield start, ids, scores


def _counts(shared, k: int, shift: int):
    """Histogram of one task: the bins of each query's ``k`` best scores; the kth best score of
    all is not below the kth best of a part, so lower bins cannot matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best = np.full((len(block.ids), k), _LOW)
        for start, _, scores in block.tiles(batches):
            if scores.shape[1] > k:
                scores = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]
            both = np.concatenate([best[start : start + len(scores)], scores], axis=1)
            best[start : start + len(scores)] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        rows, places = np.nonzero(best >= block.low[:, None])
        bins = best[rows, places] >> shift
        order = np.lexsort((bins, rows))
        rows, bins = rows[order], bins[order]
        new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (bins[1:] != bins[:-1])]) if len(rows) else rows
        counts = np.diff(np.r_[new, len(rows)])
        yield pa.RecordBatch.from_arrays([pa.array(rows[new]), pa.array(bins[new]), pa.array(counts)], names=["q", "bin", "n"])

    return run


def _locate(block: Block, candidates: DataFrame, k: int, shift: int) -> None:
    """One round: global counts, then for each query the bin that holds its kth best score."""
    shared = candidates.sparkSession.sparkContext.broadcast(block)
    counted = (
        candidates.mapInArrow(_counts(shared, k, shift), "q long, bin long, n long")
        .groupBy("q", "bin")
        .agg(F.sum("n").alias("n"))
    )
    # Counts reach back to the bin of the round before, so a query has few more than 2 ** ROUND_BITS.
    better = W.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)
    found = (
        counted.withColumn("above", F.coalesce(F.sum("n").over(better), F.lit(0)))
        .filter(F.col("above") < k)
        .groupBy("q")
        .agg(F.min("bin").alias("bin"))
        .toArrow()  # one row per query of the block
    )
    shared.unpersist()
    rows = found["q"].to_numpy()
    block.low[rows] = np.maximum(block.low[rows], found["bin"].to_numpy() << shift)


def _winners(shared, k: int):
    """Rows of one task that score at least the kth best; of its ties the smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for start, ids, scores in block.tiles(batches):
            rows, places = np.nonzero(scores >= block.low[start : start + len(scores), None])
            found, points = ids[places], scores[rows, places]
            order = np.lexsort((found, -points, rows))
            rows, found, points = rows[order], found[order], points[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids[start + rows[keep]]), pa.array(found[keep]), pa.array(points[keep])],
                names=["query_id", "vec_id", "score"],
            )

    return run


def _search(block: Block, candidates: DataFrame, k: int, bits: int) -> DataFrame:
    shift = bits
    while shift > 0:
        shift = max(0, shift - ROUND_BITS)
        _locate(block, candidates, k, shift)
    shared = candidates.sparkSession.sparkContext.broadcast(block)
    kept = candidates.mapInArrow(_winners(shared, k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame, size: int) -> Iterator[Block]:
    ids, vectors = [], []
    for row in queries.toLocalIterator():  # one partition at a time, one block in memory
        ids.append(row.vec_id)
        vectors.append(row.v)
        if len(ids) == size:
            yield Block(ids, vectors)
            ids, vectors = [], []
    if ids:
        yield Block(ids, vectors)


def top_k(
    vectors: DataFrame,
    queries: Column,
    *,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for each row that ``queries`` selects.

    Scores are integer inner products of ``floor(scale * x)``; ties go to the smaller id. Vectors
    that are NULL, or hold NULL, NaN or infinite components, take no part, nor do rows
    without id; a missing component of a shorter vector is zero. All rows under a query's id are
    its own and no candidates of it; other repeated rows are candidates of their own. If an id
    selected as query has several vectors, the smallest asks. Scores are exact for components of
    any size; what does not fit the 64-bit score counts as its least or greatest. An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    usable = quantised(vectors, vec_id, vector, scale)
    asking = quantised(vectors.filter(queries), vec_id, vector, scale).filter("vec_id IS NOT NULL")
    asking = asking.groupBy("vec_id").agg(F.min("v").alias("v"))
    widest = usable.agg(
        F.max(F.size("v")).alias("width"),
        F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("high"),
    ).first()
    bits = max(1, (max(1, widest.width or 0) * int(widest.high or 0) ** 2).bit_length())
    path = scratch_path(spark, "top-k")
    schema = "query_id long, rank int, vec_id long, score long"
    for part in _blocks(asking, block):
        found = _search(part, usable, k, min(bits, 63)).select("query_id", "rank", "vec_id", "score")
        found.write.mode("append").parquet(path)
    empty = spark.createDataFrame([], schema)
    empty.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
