"""A quality classifier: linear support vectors over n-grams scaled by naive Bayes ratios.

The n-grams are runs of one or two lower-case words, and of one to three word shapes: letter case,
digits, trailing punctuation, and whether a word repeats the one before it. Both kinds are hashed to a
fixed number of slots. Class log-count ratios are counted over all labelled rows. Support vectors are found by
dual coordinate descent, and a curve through their margins, in tasks that share out all labelled rows among
them; the model is the mean of theirs. A bounded sample of the rows can be asked for instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from barrelbook.session import bounded_batches, checkpointed

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: Slots of shapes, then those of words.
ALL_SLOTS = 2 * SLOTS
#: Labelled rows that a task fits a model to, and bytes of their slots, about.
SHARE, SHARE_BYTES = 2_000, 16_000_000
#: Bytes of texts of a sample, if one is asked for; a row that is too long for the rest is passed over.
SAMPLE_BYTES = 40_000_000
#: Parts that the sums of counts and of models are cut into.
PARTS = 16
#: Bits for a labelled row, in a set of all that tells which texts to look at, and bits of that set at most;
#: a fuller set lets more rows without label through, which the join with the labels drops.
ROW_BITS, SET_BITS = 16, 1 << 28
#: Bits of a bucket of Spark's bitmap functions.
BUCKET_BITS = 1 << 15
#: Standard errors that the ratio of a word must exceed; else rare words learn the rows by heart.
ERRORS = 2.0
THRESHOLD = 0.3
#: Shapes of words that a task remembers.
REMEMBERED = 50_000
PUNCTUATION = ".,;:!?#%&*$|\"')("
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: str) -> int:
    core = word.rstrip(PUNCTUATION)
    tail = word[len(core) :][:3]
    if not core:
        kind = "none"
    elif core.isupper():
        kind = "upper" if len(core) > 1 else "letter"
    elif core[0].isupper() and core[1:].islower():
        kind = "title"
    elif core.islower():
        kind = "lower"
    elif core.isdigit():
        kind = "digits"
    else:
        kind = "mixed"
    code = 0
    for char in f"{kind} {tail}":
        code = (code * 1_000_003 + ord(char)) & 0xFFFFFFFF
    return code


class Shapes(dict):
    """Word shapes by word; forgets everything when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = code = _shape(word)
        return code


class Words(dict):
    """Shape (high 32 bits) and hash in lower case (low ones, 0 without letters) by word; bounded like shapes."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        core = word.strip(PUNCTUATION).lower().encode("utf-8", "surrogatepass")
        self[word] = code = _shape(word) << 32 | (xxhash.xxh3_64_intdigest(core) & 0xFFFF_FFFF | 1 if core else 0)
        return code


_REPEATED = np.uint64(0xFFFF_FFFF_FFFF)
_TOP = np.uint64(64 - SLOT_BITS)


def _shape_slots(words: list[str], codes: np.ndarray) -> np.ndarray:
    if len(words) > 1:
        same = np.fromiter(map(str.__eq__, words[1:], words), dtype=bool, count=len(words) - 1)
        codes[1:][same] = _REPEATED
    length = np.array([len(words).bit_length() + 1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        one = (codes + np.uint64(1)) * _MIX
        grams = [length * _MIX ^ np.uint64(0x5555_5555_0000_0000), one]
        if len(words) > 1:
            two = (one[:-1] * np.uint64(31) + one[1:]) * _MIX
            grams.append(two)
            if len(words) > 2:
                grams.append((two[:-1] * np.uint64(37) + one[2:]) * _MIX)
        slots = np.concatenate(grams) >> _TOP
    return np.unique(slots.astype(np.int32))


def features(text: str | None, shapes: Shapes) -> np.ndarray:
    """Sorted slots of the n-grams of shapes; the length in words counts as one more n-gram."""
    words = (text or "").split()
    return _shape_slots(words, np.fromiter(map(shapes.__getitem__, words), dtype=np.uint64, count=len(words)))


def all_features(text: str | None, known: Words) -> np.ndarray:
    """Sorted slots of the n-grams of shapes and of words."""
    words = (text or "").split()
    codes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        one = (codes & np.uint64(0xFFFF_FFFF)) * _MIX
        one = one[one > 0]
        two = (one[:-1] * np.uint64(31) + one[1:]) * _MIX
        slots = np.unique((np.concatenate([one, two]) >> _TOP).astype(np.int32))
    return np.concatenate([_shape_slots(words, codes >> np.uint64(32)), slots + np.int32(SLOTS)])


def ratios_of(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratios of the classes by slot, smoothed by one; those of words move towards 0 by
    ``ERRORS`` standard errors."""
    counts = np.zeros((2, ALL_SLOTS))
    for row, sign in zip(rows, y, strict=True):
        counts[int(sign > 0), row] += 1
    return _ratios(counts)


def _ratios(counts: np.ndarray) -> np.ndarray:
    counts = counts + 1
    ratios = np.empty(ALL_SLOTS)
    for part, errors in ((slice(0, SLOTS), 0.0), (slice(SLOTS, None), ERRORS)):
        own = counts[:, part]
        shares = own / own.sum(axis=1, keepdims=True)
        ratio = np.log(shares[1] / shares[0])
        ratios[part] = np.sign(ratio) * np.maximum(0, np.abs(ratio) - errors * np.sqrt((1 / own).sum(axis=0)))
    return ratios


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = 0.01, rounds: int = 10) -> np.ndarray:
    """Weights of a linear hinge-loss model by dual coordinate descent; the last one is the bias."""
    weights, alpha = np.zeros(len(scale) + 1), np.zeros(len(rows))
    norms = np.array([(scale[r] ** 2).sum() + 1 for r in rows])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            row = rows[i]
            x = scale[row]
            gradient = y[i] * (weights[row] @ x + weights[-1]) - 1
            moved = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            step = (moved - alpha[i]) * y[i]
            if step:
                weights[row] += step * x
                weights[-1] += step
                alpha[i] = moved
    return weights


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through the margins, with Platt's smoothed targets."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -35, 35)))
        gradient = np.array([((p - target) * margins).sum(), (p - target).sum()])
        spread = p * (1 - p) + 1e-9
        hessian = np.array(
            [[(spread * margins**2).sum() + 1e-6, (spread * margins).sum()], [(spread * margins).sum(), spread.sum() + 1e-6]]
        )
        step = np.linalg.solve(hessian, gradient)
        step /= max(1.0, np.abs(step).max())
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(slope), 0.0), float(shift)


class Model:
    """Scores slots of n-grams between 0 and 1."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float):
        self.weights = weights.astype(np.float64)
        self.slope, self.shift = slope, shift

    def margin(self, row: np.ndarray) -> float:
        return float(self.weights[row].sum() + self.weights[-1])

    def score(self, row: np.ndarray) -> float:
        z = min(max(self.slope * self.margin(row) + self.shift, -35.0), 35.0)
        return float(1 / (1 + np.exp(-z)))


def fit(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray) -> Model:
    """Fit on all rows; the calibration uses margins of rows that a half model has not seen."""
    if len(rows) == 0 or (y > 0).all() or (y < 0).all():
        share = (1 + (y > 0).sum()) / (2 + len(y))
        return Model(np.zeros(ALL_SLOTS + 1), 0.0, float(np.log(share / (1 - share))))
    unseen, half = np.zeros(len(rows)), np.arange(len(rows)) % 2 == 0
    for part in (half, ~half):
        inside = np.flatnonzero(part)
        weights = descend([rows[i] for i in inside], ratios, y[inside])
        for i in np.flatnonzero(~part):
            unseen[i] = weights[rows[i]] @ ratios[rows[i]] + weights[-1]
    weights = descend(rows, ratios, y)
    slope, shift = calibrate(unseen, y)
    return Model(np.r_[weights[:-1] * ratios, weights[-1]], slope, shift)


def held_out(doc_id: Column) -> Column:
    """Rows that no model is fitted on: crc32 of the id as text is divisible by 5. NULL counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of the n-grams; copies of a row are passed over as long as their row is remembered."""
    words, seen = Words(), set()
    for batch in batches:
        found = []
        for key, content in zip(batch.select(["doc_id", "th", "label"]).to_pylist(), batch.column("text"), strict=True):
            key = tuple(key.values())
            if key not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                found.append((*key, all_features(content.as_py(), words).tobytes()))
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "th", "label", "slots"]
        )


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int, size: int) -> pa.Table:
    """``doc_id, th, label, slots`` of the sampled rows. Ids and hashes are chosen before texts are looked at."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = own.withColumn("th", F.xxhash64("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marked = marked.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.xxhash64("doc_id")
    here = own.select("doc_id", "th", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    met = here.groupBy("doc_id", "th").agg(F.max("size").alias("size")).join(marked.distinct(), "doc_id")
    first = met.orderBy(place, "th", "label").limit(sample).collect()
    chosen, room = [], size
    for row in first:
        if row["size"] <= room:
            room -= row["size"]
            chosen.append((row.doc_id, row.th, row.label))
    schema = "doc_id long, th long, label int"
    wanted = docs.sparkSession.createDataFrame(chosen, schema)  # at most ``sample`` short rows
    rows = own.join(F.broadcast(wanted), ["doc_id", "th"]).select("doc_id", "th", "label", "text")
    rows = rows.mapInArrow(_features, f"{schema}, slots binary")
    return rows.groupBy("doc_id", "th", "label").agg(F.first("slots").alias("slots")).toArrow()


def _pack(slots: np.ndarray) -> bytes:
    """Sorted slots as the gaps between them, their low, middle and high bytes apart."""
    gaps = np.diff(slots, prepend=np.int32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return zlib.compress(gaps.T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    low, middle, high = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(3, -1).astype(np.int32)
    return np.cumsum(low | middle << 8 | high << 16, dtype=np.int32)


@F.pandas_udf(BinaryType())
def _unpacked(packed: pd.Series) -> pd.Series:
    return packed.map(lambda p: _unpack(p).tobytes())


def _places(rows: DataFrame, bits: int) -> DataFrame:
    """``rows`` with the two places of their id and text in a set of so many bits."""
    both = F.xxhash64("doc_id", "th")
    return rows.withColumns({"one": F.pmod(both, F.lit(bits)), "two": F.pmod(F.shiftright(both, 32), F.lit(bits))})


def _set_of(rows: DataFrame) -> np.ndarray:
    """Bytes of a set of the ids and texts: a row of it has both its places marked, other rows seldom do."""
    bits = -(-min(max(rows.count() * ROW_BITS, 1), SET_BITS) // BUCKET_BITS) * BUCKET_BITS
    marked = _places(rows, bits).select(F.explode(F.array("one", "two")).alias("place"))
    bucket, position = F.bitmap_bucket_number(F.col("place") + 1), F.bitmap_bit_position(F.col("place") + 1)
    marked = marked.select(bucket.alias("bucket"), position.alias("position")).repartition("bucket")
    found = np.zeros((bits // BUCKET_BITS, BUCKET_BITS // 8), dtype=np.uint8)
    for batch in marked.groupBy("bucket").agg(F.bitmap_construct_agg("position")).toArrow().to_batches():
        for number, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found[number - 1] = np.frombuffer(held.as_buffer(), np.uint8)
    return found.reshape(-1)


def _packed_features(shared):
    """Packed slots of the rows in a set, and bytes of these slots unpacked; copies as in ``_features``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, held = Words(), set(), shared.value
        for batch in batches:
            one, two = (batch.column(name).to_numpy() for name in ("one", "two"))
            inside = (held[one >> 3] >> (one & 7)) & (held[two >> 3] >> (two & 7)) & 1
            batch, found = batch.filter(pa.array(inside == 1)), []
            for *key, content in zip(*(batch.column(name) for name in ("doc_id", "th", "text")), strict=True):
                key = tuple(k.as_py() for k in key)
                if key not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    slots = all_features(content.as_py(), words)
                    found.append((*key, slots.nbytes, _pack(slots)))
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "th", "size", "packed"]
            )

    return run


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """``doc_id, th, label, size, packed, slots`` of all labelled rows that are not held out, each once.

    Labels meet ids and hashes first. Then only slots are shuffled and stored, packed, and never a text;
    ``slots`` is unpacked if it is read.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = own.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("th", F.xxhash64("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marked = marked.filter(F.col("label").isin(0, 1)).distinct()
    known = checkpointed(own.select("doc_id", "th").join(marked, "doc_id").select("doc_id", "th", "label").distinct())
    held = _set_of(known)
    shared = docs.sparkSession.sparkContext.broadcast(held)  # two bytes a row, SET_BITS at most
    rows = _places(own, 8 * len(held)).mapInArrow(_packed_features(shared), "doc_id long, th long, size long, packed binary")
    found = checkpointed(rows.join(known, ["doc_id", "th"]).dropDuplicates(["doc_id", "th", "label"]))
    return found.select("doc_id", "th", "label", "size", "packed", _unpacked("packed").alias("slots"))


def _cut(values: np.ndarray) -> pa.Table:
    pieces = [zlib.compress(piece.tobytes(), 1) for piece in np.array_split(values, PARTS)]
    return pa.table({"part": pa.array(range(PARTS), pa.int64()), "sums": pa.array(pieces, pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            values = np.frombuffer(zlib.decompress(sums), np.float64)
            held[part] = held[part] + values if part in held else values
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int64()), pa.array([zlib.compress(v.tobytes(), 1) for v in held.values()], pa.binary())],
        names=["part", "sums"],
    )


def _sum_of(cut: DataFrame) -> np.ndarray:
    """Sum of the arrays that tasks have cut into parts."""
    added = {r.part: r.sums for r in cut.repartition(PARTS, "part").mapInArrow(_added, "part long, sums binary").collect()}
    return np.concatenate([np.frombuffer(zlib.decompress(added[p]), np.float64) for p in range(PARTS)])


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each class in which a slot occurs, cut into parts."""
    counts = np.zeros((2, ALL_SLOTS))
    for batch in batches:
        for label, packed in zip(batch.column("label").to_pylist(), batch.column("packed"), strict=True):
            counts[label, _unpack(packed.as_py())] += 1
    yield from _cut(counts.reshape(-1)).to_batches()


def _fitted(shared):
    """The model of a share of the rows, as what it adds to the logit, cut into parts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("th", "ascending"), ("label", "ascending")])
        rows = [_unpack(p.as_py()) for p in table["packed"]]
        model = fit(rows, np.where(table["label"].to_numpy() == 1, 1.0, -1.0), shared.value)
        return _cut(np.r_[model.weights * model.slope, model.shift])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int | None = None,
    size: int = SAMPLE_BYTES,
) -> Model:
    """Learn from all labelled rows that are not held out, or from ``sample`` of them with ``size`` bytes of text;
    labels other than 0 and 1, and rows without id, are passed over. A row that repeats teaches once, with
    each label it has.

    Without rows of both classes every text gets the smoothed share of good rows.
    """
    bounded_batches(docs.sparkSession)
    if sample is not None:
        found = _sample(docs, labels, doc_id, text, label, sample, size)
        found = found.sort_by([("doc_id", "ascending"), ("th", "ascending"), ("label", "ascending")])
        rows = [np.frombuffer(s.as_buffer(), np.int32) for s in found["slots"]]
        y = np.where(found["label"].to_numpy() == 1, 1.0, -1.0)
        return fit(rows, y, ratios_of(rows, y))
    found = _labelled(docs, labels, doc_id, text, label)
    classes = F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good")
    total = found.agg(*classes, F.sum("size").alias("size")).first()
    if not total.bad or not total.good:
        return fit([], np.ones(total.good) if total.good else -np.ones(total.bad), np.zeros(ALL_SLOTS))
    counts = _sum_of(found.select("label", "packed").mapInArrow(_slot_counts, "part long, sums binary")).reshape(2, ALL_SLOTS)
    shared = docs.sparkSession.sparkContext.broadcast(_ratios(counts))  # ALL_SLOTS numbers
    shares = max(1, round((total.bad + total.good) / SHARE), round(total.size / SHARE_BYTES))
    dealt = found.drop("size", "slots").withColumn("share", F.pmod(F.xxhash64("doc_id", "th", "label"), F.lit(shares)))
    models = _sum_of(dealt.groupBy("share").applyInArrow(_fitted(shared), "part long, sums binary"))
    mean = models / dealt.select("share").distinct().count()
    return Model(mean[:-1], 1.0, float(mean[-1]))


def with_score(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the score of their text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ALL_SLOTS + 1 weights

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        for batch in texts:
            yield pd.Series([shared.value.score(all_features(t, words)) for t in batch], dtype="float64")

    bounded_batches(docs.sparkSession)
    return docs.withColumn(name, scored(F.col(text)))


def scores(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample: int | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Only the text decides a score. NULL texts count as empty and get a score like any text;
    repeated rows get equal scores; an empty table gives no rows.
    """
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels, sample=sample), "score")
    found = scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
