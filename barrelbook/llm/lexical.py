"""Ranked lexical search by a dual tree: the best documents for every item, exactly.

Documents become vectors over the terms of a block of items once; counts over all of them give the
weights. Each task sorts its documents by their heaviest terms and searches batches of them: a
hierarchy over the documents of a batch and one over the items hold the greatest value of every
coordinate. The product of two nodes bounds all scores between them, and where it stays below the
least kth score of the items in the node, the pair is dropped with all that lies below. What is
left at the leaves is scored in whole numbers. The kth scores start from those of a sample of
documents: no document among the best can score less, whatever the sample is.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barrelbook.operators.ranking import global_position, top_k_within
from barrelbook.session import scratch_path

#: Items searched in one pass over the documents.
ITEM_BLOCK = 1024
#: Documents whose scores give the first bounds (about as many; they decide no result).
SAMPLE = 4096
#: Documents, and different terms in all of them, that a task holds at a time.
BATCH, BATCH_TERMS = 8192, 2_000_000
#: Rows of a leaf, and nodes below a node.
DOC_LEAF, ITEM_LEAF, FANOUT = 16, 4, 4
#: Cells of the dense maxima of a batch.
CELLS = 8_000_000
#: Bytes of a text that are split at a time.
PART = 1 << 22
#: What the sum of a bound may lose to rounding.
SLACK = 1 + 1e-9
_NO_ID = np.iinfo(np.int64).max

#: Digits, letters and all that is not ASCII stay, A-Z in lower case; the rest separates terms.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def term_counts(text: bytes | None) -> Counter:
    """How often each term stands in a text, split part by part between terms."""
    counts: Counter = Counter()
    if not text:
        return counts
    plain, start = text.translate(TERM_BYTES), 0
    while start < len(plain):
        end = plain.find(b" ", start + PART)
        end = len(plain) if end < 0 else end
        counts.update(plain[start:end].split())
        start = end
    return counts


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a term of weight 1 scores that stands ``tf`` times in a document of ``n`` terms."""
    m = 25 + (75 * n * documents) // max(terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class ItemTree:
    """Items in an order that puts like ones together, and the maxima of every node, by level.

    A node is ``(first item, end, columns, maxima)``; level 0 is the root, the last the leaves.
    """

    def __init__(self, items: list[dict[int, int]]):
        self.order = self._ordered(list(range(len(items))), items)
        self.columns = [np.fromiter(items[i], np.int64, len(items[i])) for i in self.order]
        self.values = [np.fromiter(items[i].values(), np.int64, len(items[i])) for i in self.order]
        widths = [ITEM_LEAF]
        while widths[-1] < len(items):
            widths.append(widths[-1] * FANOUT)
        self.widths = widths[::-1]
        self.levels = [[self._node(s, min(s + w, len(items))) for s in range(0, len(items), w)] for w in self.widths]

    @staticmethod
    def _ordered(ids: list[int], items: list[dict[int, int]]) -> list[int]:
        done, open_ = [], [ids]
        while open_:
            group = open_.pop()
            if len(group) <= ITEM_LEAF:
                done += group
                continue

            def like(one, group=group):
                of = items[one]
                return [sum(min(v, of[c]) for c, v in items[i].items() if c in of) for i in group]

            near = like(group[0])
            other = like(group[min(range(len(group)), key=near.__getitem__)])
            by = sorted(range(len(group)), key=lambda x: other[x] - near[x])
            half = len(group) // 2
            open_ += [[group[x] for x in by[half:]], [group[x] for x in by[:half]]]
        return done

    def _node(self, start: int, end: int):
        columns = np.concatenate(self.columns[start:end])
        values = np.concatenate(self.values[start:end])
        by = np.lexsort((-values, columns))
        columns, first = np.unique(columns[by], return_index=True)
        return start, end, columns, values[by][first].astype(np.float64)


class Best:
    """The best documents so far of every item (in the order of the tree), and the scores to beat."""

    def __init__(self, items: int, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors
        self.scores = [np.empty(0, np.int64)] * items
        self.ids = [np.empty(0, np.int64)] * items

    def to_beat(self, start: int, end: int) -> int:
        return min(self.least(i) for i in range(start, end))

    def least(self, item: int) -> int:
        held = self.scores[item]
        return max(int(self.floors[item]), int(held[-1]) if len(held) == self.k else 1)

    def take(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least(item)
        if not good.any():
            return
        scores, ids = np.concatenate([self.scores[item], scores[good]]), np.concatenate([self.ids[item], ids[good]])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[first], ids[first]


class DocumentTree:
    """A batch of documents, sorted by their heaviest terms, and the maxima of every node."""

    def __init__(self, ids, starts, columns, values, weights):
        counts = np.diff(starts)
        heavy = weights[columns] * values
        row = np.repeat(np.arange(len(ids)), counts)
        by = np.lexsort((columns, -heavy, row))
        top = [columns[by[np.minimum(starts[:-1] + nth, starts[1:] - 1)]] for nth in range(3)]
        order = np.lexsort(top[::-1])
        self.ids = ids[order]
        lengths = counts[order]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        pick = np.repeat(starts[order], lengths) + np.arange(self.starts[-1]) - np.repeat(self.starts[:-1], lengths)
        self.columns, self.values = columns[pick], values[pick]
        leaf = np.repeat(np.arange(len(ids)) // DOC_LEAF, lengths)
        maxima = np.zeros((-(-len(ids) // DOC_LEAF), len(weights)))
        np.maximum.at(maxima.reshape(-1), leaf * len(weights) + self.columns, self.values.astype(np.float64))
        self.levels = [maxima]
        while len(self.levels[0]) > 1:
            self.levels.insert(0, np.maximum.reduceat(self.levels[0], np.arange(0, len(self.levels[0]), FANOUT)))

    def scores(self, leaves: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents of some leaves, and their scores (item, document)."""
        rows = (leaves[:, None] * DOC_LEAF + np.arange(DOC_LEAF)).reshape(-1)
        rows = rows[rows < len(self.ids)]
        lengths = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(lengths)
        pick = np.repeat(self.starts[rows], lengths) + np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        parts = items[:, self.columns[pick]] * self.values[pick]
        return self.ids[rows], np.add.reduceat(parts, ends - lengths, axis=1)


def search(documents: DocumentTree, items: ItemTree, best: Best, terms: int) -> None:
    """Descend both trees a level at a time, then score the leaves, most promising first."""
    depth = max(len(documents.levels), len(items.levels))
    at = {0: np.zeros(1, np.int64)}  # item node to document nodes
    bounds: dict[int, np.ndarray] = {}
    for step in range(depth):
        i_level, d_level = (min(step, len(tree.levels) - 1) for tree in (items, documents))
        if step:
            at = _below(at, items, documents, i_level, d_level, i_level == step, d_level == step)
        maxima, bounds = documents.levels[d_level], {}
        for node in list(at):
            start, end, columns, values = items.levels[i_level][node]
            bound = maxima[np.ix_(at[node], columns)] @ values * SLACK
            open_ = bound >= best.to_beat(start, end)
            if open_.any():
                at[node], bounds[node] = at[node][open_], bound[open_]
            else:
                del at[node]
    dense = np.zeros((ITEM_LEAF, terms), np.int64)
    for node, leaves in at.items():
        start, end, columns, _ = items.levels[-1][node]
        for i in range(start, end):
            dense[i - start, items.columns[i]] = items.values[i]
        by = np.argsort(-bounds[node], kind="stable")
        for first in range(0, len(by), 16):
            some = by[first : first + 16]
            some = some[bounds[node][some] >= best.to_beat(start, end)]
            if not len(some):
                break
            ids, scores = documents.scores(leaves[some], dense[: end - start])
            for i in range(start, end):
                best.take(i, scores[i - start], ids)
        dense[:, columns] = 0


def _below(at, items, documents, i_level, d_level, items_too, documents_too):
    after = {}
    for node, others in at.items():
        if documents_too:
            others = (others[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
            others = others[others < len(documents.levels[d_level])]
        nodes = range(node * FANOUT, min((node + 1) * FANOUT, len(items.levels[i_level]))) if items_too else [node]
        for below in nodes:
            after[below] = others
    return after


def _vectors(vocabulary):
    """Rows of ``doc_id, text`` to ``doc_id, n, columns, tf`` over the terms of the items."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            rows = ([], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                counts = term_counts(text.as_py())
                if not counts:
                    continue
                met = [(known[t], c) for t, c in counts.items() if t in known]
                for values, value in zip(rows, (doc_id, counts.total(), [c for c, _ in met], [f for _, f in met]), strict=True):
                    values.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=["doc_id", "n", "columns", "tf"]
            )

    return vectors


def _searched(shared):
    """Vectors to the best documents of this task: ``item, doc_id, score``."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, floors, k, documents, terms = shared.value
        tree = ItemTree(items)
        best = Best(len(items), k, floors[tree.order])
        room = min(BATCH, max(DOC_LEAF, CELLS // max(1, len(weights)) * DOC_LEAF))
        held, held_rows, held_terms = [], 0, 0

        def flush():
            nonlocal held, held_rows, held_terms
            ids, starts, columns, values = (np.concatenate([h[i] for h in held]) for i in range(4))
            starts = np.concatenate([[0], np.cumsum(starts)])
            search(DocumentTree(ids, starts, columns, values, weights), tree, best, len(weights))
            held, held_rows, held_terms = [], 0, 0

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("columns")
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                columns, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("columns", "tf"))
                n = part.column("n").to_numpy().astype(np.int64)
                ids = part.column("doc_id").fill_null(_NO_ID).to_numpy().astype(np.int64)
                if not len(columns):
                    continue
                if held and (held_rows + len(ids) > room or held_terms + len(columns) > BATCH_TERMS):
                    flush()
                some = lengths > 0
                held.append((ids[some], lengths[some], columns, impacts(tf, np.repeat(n, lengths), documents, terms)))
                held_rows, held_terms = held_rows + int(some.sum()), held_terms + len(columns)
        if held:
            flush()
        for at, item in enumerate(tree.order):
            ids, scores = best.ids[at], best.scores[at]
            if len(ids):
                arrays = [pa.array(np.full(len(ids), item)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(arrays, names=["item", "doc_id", "score"])

    return searched


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best of all tasks: first among some tasks each, then of what is left."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("some", F.spark_partition_id() % 64)
    return top_k_within(top_k_within(some, ["item", "some"], order, k).drop("rank", "some"), ["item"], order, k)


def _block(spark: SparkSession, docs: DataFrame, items: list[Counter], k: int) -> DataFrame:
    """``item, rank, doc_id, score`` for the items of a block, numbered from 0."""
    vocabulary = {term: i for i, term in enumerate(sorted({t for counts in items for t in counts}))}
    result = "item long, doc_id long, score long"
    if not vocabulary:
        return spark.createDataFrame([], "item long, rank long, doc_id long, score long")
    context = spark.sparkContext
    path = scratch_path(spark, "vectors")
    made = docs.mapInArrow(_vectors(context.broadcast(vocabulary)), "doc_id long, n long, columns array<int>, tf array<long>")
    made.write.parquet(path)
    vectors = spark.read.parquet(path)
    documents, terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = vectors.select(F.explode("columns").alias("column")).groupBy("column").count().collect()
    weights = np.full(len(vocabulary), weight(documents, 0), np.int64)
    for column, count in held:
        weights[column] = weight(documents, count)
    columns = [{vocabulary[t]: int(weights[vocabulary[t]]) * c for t, c in counts.items()} for counts in items]
    columns = [{c: v for c, v in x.items() if v} or {0: 0} for x in columns]

    def run(rows: DataFrame, floors: np.ndarray) -> DataFrame:
        shared = context.broadcast((columns, weights, floors, k, documents, terms))
        return _merged(rows.mapInArrow(_searched(shared), result), k)

    rows = vectors.filter(F.size("columns") > 0)
    floors = np.ones(len(items), np.int64)
    share = documents // SAMPLE
    if share > 1:
        sample = rows.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(share)) == 0)
        for row in run(sample, floors).filter(F.col("rank") == k).collect():
            floors[row.item] = row.score
    return run(rows, floors)


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 10, *, doc_id="doc_id", item_id="item_id", text="text", block: int = ITEM_BLOCK
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item, best first.

    A document scores the sum over the item's terms, repeats included, of the term's weight by what
    its count in the document gives at the document's length; scores are whole numbers, equal ones
    go by ascending document id, NULL last. Only scores above 0 count, so an item without a term
    that any document holds has no rows. NULL texts have no terms. Repeated rows of either table
    are rows of their own. Items are searched in blocks of ``block``, each against all documents;
    a block's terms and items are what is broadcast. Empty tables give no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text"))
    numbered = global_position(asked, [F.col("item_id").asc(), F.col("text").asc()], "number")
    number = F.col("number") - 1
    blocks = numbered.select(F.floor(number / block).alias("block")).agg(F.max("block")).first()[0]
    schema = f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id long, score long"
    if blocks is None:
        return spark.createDataFrame([], schema)
    result = None
    for at in range(blocks + 1):
        rows = numbered.filter(F.floor(number / block) == at).orderBy("number").collect()
        found = _block(spark, own, [term_counts(r.text) for r in rows], k)
        names = numbered.select("item_id", (number - at * block).alias("item")).filter(
            (F.col("item") >= 0) & (F.col("item") < block)
        )
        met = found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        result = met if result is None else result.unionByName(met)
    return result
