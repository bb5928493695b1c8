"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages. A randomised SVD over TF-IDF vectors of all blocks of the
documents and of the items gives a latent space: Spark counts in how many blocks every two terms meet,
and multiplies by these counts. Passages whose cosine with an item is high there are candidates. So is every stretch that holds as many of an item's words as the checks ask
for, so none that would pass them depends on the space. A longest common subsequence of words and
a check of the item's answer decide, so reworded copies are found and passages that merely share a
subject are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrelbook.llm.pages import aligned
from barrelbook.session import bounded_batches, checkpointed, scratch_path

#: A passage is two neighbouring blocks of words.
BLOCK_WORDS = 16
#: Items that are searched in one pass over the documents: so many, or so many different words.
ITEMS, WORDS = 4_096, 16_384
RANK, EXTRA, POWERS = 256, 16, 2
#: Weight of an item in the space, and what all documents weigh together there, in weights of all items. Items
#: that weigh little have little length in the space, and their cosines tell nothing.
ITEM_WEIGHT, DOCS_WEIGHT = 8.0, 2.0
#: Groups of items with a bound of their own, at least.
GROUPS = 16
COSINE, SHARED, ANSWER = 0.2, 0.6, 0.6
CHUNK_WORDS = 20_000
#: Passages that are summed at a time.
SUMMED = 2_048
#: Pairs of blocks and items, and words of such pairs, that are counted together.
PAIRS, PAIR_WORDS = 1 << 16, 1 << 20
#: Pairs of terms that a task adds up before it sorts them, and different ones that it holds before it sends them.
PENDING, HELD = 1 << 20, 1 << 22
#: Parts of the sums over pairs of terms, and tasks that multiply by them. Each row of a product comes from one task.
PARTS, TASKS = 64, 16
_MARKS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]")  # punctuation beyond ASCII
_WORD_BYTES = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case; they end at white space and punctuation."""
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub(" ", text)
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split()


def answer_at(text: str) -> int:
    """Number of words before the answer: what follows the last question mark or ``answer:``, else
    the last sentence, else the last quarter."""
    total = len(words_of(text))
    for mark in (r"answer\s*:", r"\?", r"[.!]\s"):
        for found in reversed(list(re.finditer(mark, text, re.I))):
            before = len(words_of(text[: found.end()]))
            if total - before >= 3:
                return before
    return total - max(1, total // 4)


@dataclass
class Items:
    """A bounded block of items with the words they use."""

    ids: list[int | None]
    words: list[list[int]]
    answers: list[int]
    vocabulary: dict[bytes, int]


def _item_blocks(items: DataFrame, most: int, most_words: int) -> Iterator[Items]:
    block = Items([], [], [], {})
    for row in items.toLocalIterator():  # one partition at a time, one block in memory
        words = words_of(row.text)
        if not words:
            continue
        if block.ids and (len(block.ids) >= most or len(block.vocabulary) + len(set(words)) > most_words):
            yield block
            block = Items([], [], [], {})
        known = block.vocabulary
        block.ids.append(row.item_id)
        block.words.append([known.setdefault(w, len(known)) for w in words])
        block.answers.append(answer_at(row.text))
    if block.ids:
        yield block


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Different keys in order. Sorting beats the hash table of ``np.unique`` here."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


class Chunk:
    """Texts as word numbers, padded to whole blocks, with the terms of every block."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, starts: list[int], size: int):
        self.ids, self.docs, self.starts = ids, docs, starts
        pad, other = size, size + 1
        blocks = np.arange(len(ids)) // BLOCK_WORDS
        known = ids < pad
        keys = _distinct(blocks[known] * (size + 2) + ids[known])
        self.blocks, self.terms = keys // (size + 2), keys % (size + 2)
        self.others = np.bincount(blocks[ids == other], minlength=len(docs))
        last = np.r_[docs[1:] != docs[:-1], True] if len(docs) else np.empty(0, bool)
        self.single = last & np.r_[True, docs[1:] != docs[:-1]] if len(docs) else last
        #: A passage starts at each block but the last of a text, unless that is its only one.
        self.passages = np.flatnonzero(~last | self.single)

    def energy(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.blocks, weights=weights[self.terms], minlength=len(self.docs))

    def both(self, values: np.ndarray) -> np.ndarray:
        """Sums over the blocks of each passage."""
        after = np.r_[values[1:], 0][self.passages] if len(values) else values
        return values[self.passages] + np.where(self.single[self.passages], 0, after)

    def most(self, values: np.ndarray) -> np.ndarray:
        """The greatest sum, over the columns of ``values``, of the terms of each passage; a term of both blocks
        counts twice. Blocks are summed some at a time, so that a long text takes no more memory for it."""
        edges = np.searchsorted(self.blocks, np.arange(len(self.docs) + 1))
        most = np.zeros(len(self.passages))
        for low in range(0, len(self.passages), SUMMED):
            some = self.passages[low : low + SUMMED]
            first, last = int(some[0]), min(int(some[-1]) + 2, len(self.docs))
            terms = self.terms[edges[first] : edges[last]]
            total = np.zeros((len(terms) + 1, values.shape[1]))
            np.cumsum(values[terms], axis=0, out=total[1:])
            ends = edges[some + np.where(self.single[some], 1, 2)]
            sums = total[ends - edges[first]] - total[edges[some] - edges[first]]
            most[low : low + SUMMED] = sums.max(axis=1, initial=0)
        return most

    def passage_terms(self, passage: int) -> np.ndarray:
        end = passage + (1 if self.single[passage] else 2)
        low, high = np.searchsorted(self.blocks, (passage, end))
        return _distinct(self.terms[low:high])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Every (passage, term), once."""
        size = int(self.terms.max(initial=0)) + 1
        begins = np.zeros(len(self.docs) + 1, dtype=bool)
        begins[self.passages] = True
        second = begins[self.blocks - 1] & (self.blocks > 0) & ~self.single[np.maximum(self.blocks - 1, 0)]
        keys = _distinct(
            np.r_[
                (self.blocks * size + self.terms)[begins[self.blocks]], ((self.blocks - 1) * size + self.terms)[second]
            ]
        )
        return keys // size, keys % size


def _chunks(texts: list[str | None], vocabulary: dict[bytes, int]) -> Iterator[Chunk]:
    size = len(vocabulary)
    pad, other = size, size + 1
    ids: list[int] = []
    docs: list[int] = []
    starts: list[int] = []
    find = vocabulary.get
    for number, text in enumerate(texts):
        words = words_of(text)
        if not words:
            continue
        starts.append(number)
        ids.extend(map(find, words, repeat(other)))
        ids.extend([pad] * (-len(words) % BLOCK_WORDS))
        docs.extend([number] * (-(-len(words) // BLOCK_WORDS)))
        if len(ids) >= CHUNK_WORDS:
            yield Chunk(np.array(ids), np.array(docs), starts, size)
            ids, docs, starts = [], [], []
    if ids:
        yield Chunk(np.array(ids), np.array(docs), starts, size)


# --- corpus statistics ------------------------------------------------------------------------


def _summed(keys: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order with the sums of their values, or how often they occur."""
    if not len(keys):
        return keys, np.empty(0)
    if values is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sums = np.diff(np.r_[first, len(keys)]).astype(np.float64) if values is None else np.add.reduceat(values, first)
    return keys[first], sums


class Sums:
    """Sums by key. Whoever adds takes them out whenever they are ``full``."""

    def __init__(self):
        self.keys, self.values, self.waiting, self.size = np.empty(0, np.int64), np.empty(0), [], 0

    def add(self, keys: np.ndarray, values: np.ndarray | None = None) -> None:
        self.waiting.append((keys, values))
        self.size += len(keys)
        if self.size >= PENDING:
            self.merge()

    def merge(self) -> None:
        counted = [k for k, v in self.waiting if v is None]
        parts = [(self.keys, self.values), *[w for w in self.waiting if w[1] is not None]]
        if counted:
            parts.append(_summed(np.concatenate(counted)))
        self.keys, self.values = _summed(*map(np.concatenate, zip(*parts, strict=True)))
        self.waiting, self.size = [], 0

    @property
    def full(self) -> bool:
        return len(self.keys) >= HELD

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        found = self.keys, self.values
        self.keys, self.values = np.empty(0, np.int64), np.empty(0)
        return found


SUMS = "part long, keys binary, sums binary"


def _bounds(size: int) -> np.ndarray:
    """Terms at which the parts of the pairs (i, j), i <= j, begin; parts have about equally many pairs."""
    parts = max(1, min(PARTS, size))
    return np.unique(np.r_[np.round(size * (1 - np.sqrt(1 - np.arange(parts) / parts))).astype(np.int64), size])


def _sums_batch(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Packed rows. Keys are in order and stored as steps, which compress well."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([np.diff(r[1], prepend=0).astype("<i8").tobytes() for r in rows], pa.binary()),
            pa.array([r[2].astype("<f8").tobytes() for r in rows], pa.binary()),
        ],
        names=["part", "keys", "sums"],
    )


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for part, keys, sums in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "sums")), strict=True):
        yield part, np.cumsum(np.frombuffer(keys, "<i8")), np.frombuffer(sums, "<f8")


def _parted(keys: np.ndarray, sums: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sums by pairs of terms, ``i * size + j``, cut into parts."""
    cuts = np.searchsorted(keys, bounds * bounds[-1])
    for part, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if low < high:
            yield part, keys[low:high], sums[low:high]


def _meetings(blocks: np.ndarray, terms: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Pairs of terms, ``i * size + j`` with ``i <= j``, of every block. Terms rise within a block."""
    for step in range(BLOCK_WORDS):
        left, right = slice(0, max(0, len(terms) - step)), slice(step, None)
        same = blocks[left] == blocks[right]
        if not same.any():
            return
        yield terms[left][same] * size + terms[right][same]


def _counted(shared, bounds: np.ndarray):
    """Blocks in which two terms meet, by parts. Part -1 has the number of passages (key -1), those in which
    each term of the items occurs, and from key ``size`` on the fitted blocks with each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, size = shared.value.vocabulary, int(bounds[-1])
        counts, total, met = np.zeros(2 * size, dtype=np.int64), 0, Sums()
        for batch in batches:
            fitted = batch.column("fitted").to_numpy(zero_copy_only=False)
            for chunk in _chunks(batch.column("text").to_pylist(), vocabulary):
                counts[:size] += np.bincount(chunk.pairs()[1], minlength=size)
                inside = fitted[chunk.docs[chunk.blocks]]
                counts[size:] += np.bincount(chunk.terms[inside], minlength=size)
                total += len(chunk.passages)
                for keys in _meetings(chunk.blocks[inside], chunk.terms[inside], size):
                    met.add(keys)
                if met.full:
                    yield _sums_batch(list(_parted(*met.taken(), bounds)))
        used = np.flatnonzero(counts)
        yield _sums_batch([(-1, np.r_[-1, used], np.r_[total, counts[used]]), *_parted(*met.taken(), bounds)])

    return run


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each part."""
    held: dict[int, Sums] = {}
    for batch in batches:
        for part, keys, sums in _unpacked(batch):
            held.setdefault(part, Sums()).add(keys, sums)
    for part in list(held):
        yield _sums_batch([(part, *held.pop(part).taken())])


def _gathered(sums: DataFrame, bounds: np.ndarray) -> DataFrame:
    """The sums of all tasks, one row per part."""
    return checkpointed(sums.repartition(len(bounds), "part").mapInArrow(_added_up, SUMS))


def _weights(met: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies over all passages, the last that of an unknown word, and the fitted blocks
    with each term."""
    counts = np.zeros(2 * size + 1)  # the last is the number of passages
    for batch in met.filter("part = -1").toArrow().to_batches():
        for _, keys, sums in _unpacked(batch):
            counts[keys] = sums
    passages = np.r_[counts[:size], 0]
    return np.log((1 + counts[-1]) / (1 + passages)) + 1, counts[size:-1]


# --- latent space -----------------------------------------------------------------------------


def _crossed(bounds: np.ndarray):
    """Sums of the products of every two entries of packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, met = int(bounds[-1]), Sums()
        for batch in batches:
            for terms, x in zip(batch.column("terms").to_pylist(), batch.column("x").to_pylist()):
                terms, x = np.frombuffer(terms, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64)
                i, j = np.triu_indices(len(terms))
                i, j = np.where(terms[i] <= terms[j], (i, j), (j, i))
                met.add(terms[i] * size + terms[j], x[i] * x[j])
                if met.full:
                    yield _sums_batch(list(_parted(*met.taken(), bounds)))
        yield _sums_batch(list(_parted(*met.taken(), bounds)))

    return run


def _row_bounds(size: int) -> np.ndarray:
    """Terms at which the parts of the pairs (i, j) of any order begin, each of whole rows."""
    return np.unique(np.round(np.linspace(0, size, 2 * max(1, min(PARTS, size)) + 1)).astype(np.int64))


def _mirrored(bounds: np.ndarray):
    """Sums by pairs (i, j), i <= j, as sums by (i, j) and (j, i)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = int(bounds[-1])
        for batch in batches:
            for _, keys, sums in _unpacked(batch):
                i, j = keys // size, keys % size
                apart = i < j
                keys, sums = _summed(np.r_[keys, (j * size + i)[apart]], np.r_[sums, sums[apart]])
                yield _sums_batch(list(_parted(keys, sums, bounds)))

    return run


def _product(basis, weights: np.ndarray, bounds: np.ndarray):
    """What the rows of each part give times the basis. Each term's sums are weighted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, size = basis.value, int(bounds[-1])
        for batch in batches:
            for part, keys, sums in _unpacked(batch):
                low, high = int(bounds[part]), int(bounds[part + 1])
                rows = np.zeros((high - low, size))
                rows.reshape(-1)[keys - low * size] = sums * weights[keys // size] * weights[keys % size]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int64()), pa.array([(rows @ q).tobytes()], pa.binary())], names=["part", "sums"]
                )

    return run


def latent_space(sample: DataFrame, items: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Orthonormal terms-by-rank basis of the leading right singular space of packed rows ``terms, x`` and items.

    ``items`` is a dense items-by-terms matrix.
    """
    size = items.shape[1]
    bounds = _bounds(size)
    return _leading(_gathered(sample.mapInArrow(_crossed(bounds), SUMS), bounds), np.ones(size), items, rank)


def _leading(met: DataFrame, weights: np.ndarray, items: np.ndarray, rank: int) -> np.ndarray:
    """The same of rows of which ``met`` has the sums over pairs of terms.

    The sums are stored once more with both orders of a pair, so that a task has whole rows of them: every
    product is a Spark job without a shuffle, and the driver sees only terms-by-rank matrices.
    """
    context, size = met.sparkSession.sparkContext, items.shape[1]
    bounds, width = _row_bounds(size), min(size, rank + EXTRA)
    met = _gathered(met.filter("part >= 0").mapInArrow(_mirrored(bounds), SUMS), bounds).coalesce(TASKS)

    def times(q: np.ndarray) -> np.ndarray:
        basis = context.broadcast(q)
        rows = met.mapInArrow(_product(basis, weights, bounds), "part long, sums binary").collect()
        basis.destroy()
        total = ITEM_WEIGHT * (items.T @ (items @ q))
        for r in rows:
            total[bounds[r.part] : bounds[r.part + 1]] += np.frombuffer(r.sums, "<f8").reshape(-1, q.shape[1])
        return total

    q = np.linalg.qr(np.random.default_rng(0).normal(size=(size, width)))[0]
    for _ in range(POWERS):
        q = np.linalg.qr(times(q))[0]
    values, vectors = np.linalg.eigh(q.T @ times(q))
    return q @ vectors[:, np.argsort(-values)[: min(rank, width)]]


# --- search -----------------------------------------------------------------------------------


@dataclass
class Space:
    weights: np.ndarray
    basis: np.ndarray
    items: np.ndarray  # unit vectors of the items in the space
    most: np.ndarray  # what each term adds to an inner product at most, by group of items


def _space(weights: np.ndarray, basis: np.ndarray, rows: np.ndarray) -> Space:
    latent = rows @ basis
    norms = np.linalg.norm(latent, axis=1, keepdims=True)
    latent = latent / np.where(norms == 0, 1, norms)
    groups = np.array_split(latent, min(len(latent), max(GROUPS, len(latent) // 64)))
    most = np.stack([(basis @ part.T).max(axis=1, initial=0) for part in groups], axis=1) * weights[:-1, None]
    return Space(weights, basis, latent, np.ascontiguousarray(most, dtype=np.float32))


def _unit_items(items: Items, weights: np.ndarray) -> np.ndarray:
    rows = np.zeros((len(items.ids), len(items.vocabulary)))
    for row, words in zip(rows, items.words):
        terms = sorted(set(words))
        row[terms] = weights[terms]
        row /= np.linalg.norm(row)
    return rows


def candidates(chunk: Chunk, space: Space, least: float) -> Iterator[tuple[int, int, float]]:
    """(passage, item, cosine) of at least ``least``.

    What a passage holds beyond the items' words counts in its length. Passages whose terms
    cannot add up to the bound with any item are passed over; none that reaches it is lost.
    """
    added = chunk.most(space.most) * (1 + 1e-4)  # sums of rounded numbers
    energy = chunk.energy(space.weights**2)
    unknown = chunk.both(chunk.others) * space.weights[-1] ** 2
    after = np.where(chunk.single[chunk.passages], 0, np.r_[energy[1:], 0][chunk.passages])
    length = np.sqrt(np.maximum(energy[chunk.passages], after) + unknown)  # at most the true one
    for place in np.flatnonzero((added >= least * length) & (added > 0)).tolist():
        passage = int(chunk.passages[place])
        terms = chunk.passage_terms(passage)
        x = space.weights[terms]
        cosines = space.items @ (x @ space.basis[terms]) / np.sqrt(x @ x + unknown[place])
        for item in np.flatnonzero(cosines >= least).tolist():
            yield passage, item, float(cosines[item])


# --- search by words --------------------------------------------------------------------------


def least_words(count: int, share: float) -> int:
    """The smallest number of ``count`` words that is at least ``share`` of them."""
    return next((k for k in range(count + 1) if k >= share * count and (not count or k / count >= share)), count + 1)


@dataclass
class Gate:
    """What a stretch must hold of the items, as runs of flat arrays."""

    posts: np.ndarray  # where the run of each term begins in ``posted``
    posted: np.ndarray  # items that have the term among their rare words
    edges: np.ndarray  # where the run of each item begins in ``terms``
    terms: np.ndarray
    times: np.ndarray  # how often the item and its answer use the term
    need: np.ndarray  # words of the item and of its answer that have to be there
    reach: np.ndarray
    step: np.ndarray


def stretches(length: int) -> tuple[int, int]:
    """Length of the stretches that are compared with an item, and how far apart they begin."""
    return length + length // 2 + 1, max(1, length // 8)


def gate_of(items: Items, weights: np.ndarray, shared: float, answer: float) -> Gate:
    """Of ``n`` words of which ``need`` have to be there, one of any ``n - need + 1`` is there: a
    stretch is looked at only if it has one of that many rare words, of the item or of its answer,
    whichever occur less. Where both shares are 0 the latent space alone decides."""
    common = np.exp(-weights[:-1])
    posted: list[list[int]] = [[] for _ in items.vocabulary]
    edges, terms, times, need = [0], [], [], []
    for number, (words, begin) in enumerate(zip(items.words, items.answers)):
        least, options = [], []
        for part, share in ((words, shared), (words[begin:], answer)):
            least.append(least_words(len(part), share))
            if least[-1] > 0:
                rare = set(sorted(part, key=common.__getitem__)[: max(0, len(part) - least[-1] + 1)])
                options.append((sum(common[t] for t in rare), rare))
        for term in min(options, key=lambda o: o[0])[1] if options else ():
            posted[term].append(number)
        used, whole = np.unique(words, return_counts=True)
        ends = np.array(words[begin:], dtype=np.int64)
        times.append(np.stack([whole, [np.count_nonzero(ends == t) for t in used]], axis=1))
        terms.append(used)
        edges.append(edges[-1] + len(used))
        need.append(least)
    reach, step = np.array([stretches(len(words)) for words in items.words]).T
    posts = np.cumsum([0, *map(len, posted)])
    flat = np.array([i for run in posted for i in run], dtype=np.int64)
    return Gate(posts, flat, np.array(edges), np.concatenate(terms), np.concatenate(times), np.array(need), reach, step)


def _runs(edges: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen runs, and which of the chosen each belongs to."""
    sizes = edges[chosen + 1] - edges[chosen]
    owner = np.repeat(np.arange(len(chosen)), sizes)
    return np.arange(len(owner)) + (edges[chosen] - (np.cumsum(sizes) - sizes))[owner], owner


def _parts(edges: np.ndarray, chosen: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ``chosen`` whose runs have about ``most`` places at once."""
    ends = np.cumsum(edges[chosen + 1] - edges[chosen])
    cuts = np.searchsorted(ends, np.arange(most, ends[-1] if len(ends) else 0, most), side="right")
    bounds = _distinct(np.r_[0, cuts, len(chosen)])
    return map(slice, bounds[:-1].tolist(), bounds[1:].tolist())


def gated(chunk: Chunk, gate: Gate) -> Iterator[tuple[int, int, int, int]]:
    """(block, item, begin, end) wherever words of a text may pass the checks.

    From ``begin`` to ``end`` lie all stretches that meet the block, counted from the text's
    begin. They hold enough words of the item and of its answer, in any order; every stretch of
    the text that holds enough of them in order is among them.
    """
    first = np.searchsorted(chunk.docs, chunk.docs) * BLOCK_WORDS
    last = np.searchsorted(chunk.docs, chunk.docs, side="right") * BLOCK_WORDS
    span, count = len(chunk.ids) + 1, len(gate.need)
    places = np.flatnonzero(chunk.ids < len(gate.posts) - 1)
    held = np.sort(chunk.ids[places] * span + places)
    for part in _parts(gate.posts, chunk.terms, PAIRS):
        at, owner = _runs(gate.posts, chunk.terms[part])
        keys = _distinct(chunk.blocks[part][owner] * count + gate.posted[at])
        for some in _parts(gate.edges, keys % count, PAIR_WORDS):
            blocks, items = keys[some] // count, keys[some] % count
            begin = np.maximum(blocks * BLOCK_WORDS - gate.reach[items] + 1, first[blocks])
            begin -= (begin - first[blocks]) % gate.step[items]
            end = np.minimum((blocks + 1) * BLOCK_WORDS + gate.reach[items], last[blocks])
            at, owner = _runs(gate.edges, items)
            base = gate.terms[at] * span
            there = np.searchsorted(held, base + end[owner]) - np.searchsorted(held, base + begin[owner])
            enough = np.ones(len(items), dtype=bool)
            for which in (0, 1):
                words = np.bincount(owner, np.minimum(there, gate.times[at, which]), minlength=len(items))
                enough &= words >= gate.need[items, which]
            yield from zip(*(x[enough].tolist() for x in (blocks, items, begin, end)))


def _near(chunk: Chunk, space: Space, block: int, item: int) -> float:
    """The highest cosine of the item with the passages that hold the block."""
    best = -1.0
    for place in np.flatnonzero((chunk.passages == block) | (chunk.passages == block - 1)).tolist():
        passage = int(chunk.passages[place])
        if chunk.docs[passage] != chunk.docs[block]:
            continue
        terms = chunk.passage_terms(passage)
        x = space.weights[terms]
        unknown = chunk.others[passage] + (0 if chunk.single[passage] else chunk.others[passage + 1])
        length = np.sqrt(x @ x + unknown * space.weights[-1] ** 2)
        if length:
            best = max(best, float(space.items[item] @ (x @ space.basis[terms]) / length))
    return best


# --- checks -----------------------------------------------------------------------------------


def _places(words: list[int]) -> dict[int, int]:
    """Where each word stands, as bits."""
    places: dict[int, int] = {}
    for place, word in enumerate(words):
        places[word] = places.get(word, 0) | 1 << place
    return places


def _in_order(places: dict[int, int], count: int, around: list[int]) -> int:
    """Length of the longest common subsequence of ``count`` words and the text around."""
    full = (1 << count) - 1
    row = full
    for hits in filter(None, map(places.get, around)):
        hit = row & hits
        row = ((row + hit) | (row - hit)) & full
    return count - row.bit_count()


def verified(words: list[int], answer: int, around: list[int]) -> tuple[float, float, int, int]:
    """Shares of the item and of its answer that the text around a passage holds in order.

    Stretches half as long again as the item are tried along the text, and the best one counts.
    """
    reach, step = stretches(len(words))
    whole, ends = _places(words), _places(words[answer:])
    parts = [around[begin : begin + reach] for begin in range(0, max(1, len(around) - reach + step), step)]
    counts = [_in_order(whole, len(words), part) for part in parts]
    most = max(counts)
    if not most:
        return 0.0, 0.0, 0, 0
    answered = [(_in_order(ends, len(words) - answer, part), -n) for n, part in enumerate(parts) if counts[n] == most]
    found, number = max(answered)
    places, begin = aligned(parts[-number], words), -number * step
    share = found / (len(words) - answer) if found else 0.0
    return most / len(words), share, begin + places[0], begin + places[-1] + 1


def _leaks(shared_items, shared_space, shared_gate, cosine: float, shared_words: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, space, gate = shared_items.value, shared_space.value, shared_gate.value
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64(), pa.int64()]
        for batch in batches:
            keys, digests = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
            out = []
            for chunk in _chunks(batch.column("text").to_pylist(), items.vocabulary):
                best: dict[tuple[int, int], tuple] = {}
                first = np.searchsorted(chunk.docs, chunk.docs) * BLOCK_WORDS
                last = np.searchsorted(chunk.docs, chunk.docs, side="right") * BLOCK_WORDS
                for passage, item, near in candidates(chunk, space, cosine):
                    words = items.words[item]
                    begin = max(int(first[passage]), passage * BLOCK_WORDS - len(words))
                    end = min(int(last[passage]), (passage + 2) * BLOCK_WORDS + len(words))
                    around = chunk.ids[begin:end].tolist()
                    share, answered, at, until = verified(words, items.answers[item], around)
                    if share < shared_words or answered < answer:
                        continue
                    doc, base = int(chunk.docs[passage]), begin - int(first[passage])
                    row = (share, near, answered, base + at, base + until)
                    if row > best.get((doc, item), ()):
                        best[doc, item] = row
                seen = set(best)
                for block, item, begin, end in gated(chunk, gate):
                    doc = int(chunk.docs[block])
                    if (doc, item) in seen:
                        continue
                    share, answered, at, until = verified(items.words[item], items.answers[item], chunk.ids[begin:end].tolist())
                    if share < shared_words or answered < answer:
                        continue
                    base = begin - int(first[block])
                    row = (share, _near(chunk, space, block, item), answered, base + at, base + until)
                    if row > best.get((doc, item), ()):
                        best[doc, item] = row
                for (doc, item), (share, near, answered, at, until) in best.items():
                    out.append((keys[doc], digests[doc], items.ids[item], near, share, answered, at, until))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in LEAK.split(", ")]
            )

    return run


LEAK = "doc_id long, th long, item_id long, cosine double, shared double, answer double, first_word long, end_word long"


def leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    cosine: float = COSINE,
    shared: float = SHARED,
    answer: float = ANSWER,
    rank: int = RANK,
    sample_docs: int | None = None,
    item_block: int = ITEMS,
) -> DataFrame:
    """A row for every document and item of which it holds a passage.

    Passages with a ``cosine`` of at least that are checked, and so is every stretch that holds
    the asked shares of an item's words and of its answer's; rows of these can have any cosine.

    ``cosine`` is that of the best passage in the latent space, ``shared`` the share of the
    item's words that the document holds in order, ``answer`` that of the answer's words, and
    ``first_word`` to ``end_word`` the stretch in the document. ``th`` is ``xxhash64(text)`` and
    tells apart texts under one id. All documents shape the space; with ``sample_docs`` about so many do, and
    the rows are the same. Items are taken in blocks of bounded size. NULL and empty
    texts and items have no words and give no rows; repeated rows give repeated rows; NULL ids
    stay NULL; empty tables give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    context = spark.sparkContext
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")
    ).filter("text IS NOT NULL")
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    path = scratch_path(spark, "benchmark-leaks")
    fitted = F.lit(True)
    if sample_docs is not None:
        share = min(1.0, sample_docs / max(1, docs.count()))
        fitted = F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    counted = slim.select("text", fitted.alias("fitted"))
    for block in _item_blocks(asked, item_block, WORDS):
        known, bounds = context.broadcast(block), _bounds(len(block.vocabulary))
        met = _gathered(counted.mapInArrow(_counted(known, bounds), SUMS), bounds)
        weights, blocks = _weights(met, len(block.vocabulary))
        rows = _unit_items(block, weights)
        energy = max(1.0, float(blocks @ weights[:-1] ** 2))
        scaled = weights[:-1] * np.sqrt(DOCS_WEIGHT * ITEM_WEIGHT * len(rows) / energy)
        basis = _leading(met, scaled, rows, rank)
        space = context.broadcast(_space(weights, basis, rows))
        gate = context.broadcast(gate_of(block, weights, shared, answer))
        slim.mapInArrow(_leaks(known, space, gate, cosine, shared, answer), LEAK).write.mode("append").parquet(path)
        for sent in (known, space, gate):  # the driver and every executor have a file of each
            sent.destroy()
    spark.createDataFrame([], LEAK).write.mode("append").parquet(path)
    return spark.read.schema(LEAK).parquet(path)
