"""Exact repeated substrings across documents, by suffix arrays built in two stages.

Whole suffix arrays of a corpus do not fit any task, so windows of ``span`` bytes are first dealt
by an anchor: the gram of ``gram`` bytes inside the window with the smallest hash. Equal windows
have equal anchors at equal places, so equal windows always meet. Consecutive windows with one
anchor form a piece. Anchors that occur once are dropped (no window around them can repeat);
pieces with equal bytes are kept once with a flag; and the different pieces of an anchor go
through the suffix array: suffixes smaller than their successors are sorted directly, the rest
is induced by bucket scans, and adjacent common prefixes of ``span`` bytes mark the windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barrelbook.session import bounded_batches, checkpointed

SPAN, GRAM = 200, 100
#: Bytes that are hashed at once; longer texts are cut into segments that overlap by a window.
SEGMENT = 1 << 18
#: Bytes of one suffix array. Anchors with more text take the exact way by window digests.
CHUNK = 1 << 21
#: The filter of repeated anchors has this many bits whatever the input; a full filter lets more
#: rows through and changes no result.
FILTER_BITS = 1 << 27
#: Likewise for the filters of texts that take part in a join.
TEXT_BITS = 1 << 24
FILTER_PARTS = 256
#: Anchors with more than this share of all pieces are settled in two steps; there are at most
#: as many of them as the share has parts.
HEAVY_PARTS, SALTS = 2_000, 64

ROW = "kind int, h long, c1 long, c2 long, doc_id long, th long, start long, length int, multi int"
MARK, CANDIDATE, ASK, AGAIN = 0, 1, 2, 3
_NAMES = [field.split()[0] for field in ROW.split(", ")]


# --- anchors and pieces -----------------------------------------------------------------------


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every gram, by combining hashes of powers of two."""
    with np.errstate(over="ignore"):
        seed = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        seed ^= seed >> np.uint64(29)
        seed *= np.uint64(0xBF58476D1CE4E5B9)
        power, width, done, offset = seed[data], 1, None, 0
        base = np.uint64(0x100000001B3)
        rest = gram
        while True:
            if rest & 1:
                if done is None:
                    done = power.copy()
                else:
                    count = len(power) - offset
                    factor = np.uint64(pow(int(base), width, 1 << 64))
                    done = done[:count] * factor + power[offset : offset + count]
                offset += width
            rest >>= 1
            if not rest:
                break
            factor = np.uint64(pow(int(base), width, 1 << 64))
            power = power[:-width] * factor + power[width:]
            width *= 2
        done ^= done >> np.uint64(31)
        done *= np.uint64(0x94D049BB133111EB)
        done ^= done >> np.uint64(27)
    return done


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every run of ``width`` values."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    if step < width:
        values = np.minimum(values[: len(values) - (width - step)], values[width - step :])
    return values


def pieces_of(data: np.ndarray, bounds: np.ndarray, span: int, gram: int):
    """Anchor hash, start and end of every piece of the texts between ``bounds`` in ``data``."""
    total = len(data)
    empty = np.empty(0, np.int64)
    if total < span:
        return empty.astype(np.uint64), empty, empty
    hashes = _gram_hashes(data, gram)
    places = np.arange(len(hashes), dtype=np.uint64)
    # The high half of the hash, then the place: of equal ones the first, whatever buffer the text lies in.
    packed = (hashes >> np.uint64(32) << np.uint64(32)) | places
    anchors = (_sliding_min(packed, span - gram + 1) & np.uint64(0xFFFF_FFFF)).astype(np.int64)
    last = np.repeat(bounds[1:], np.diff(bounds))[: len(anchors)]
    valid = np.arange(len(anchors)) + span <= last
    starts = np.flatnonzero(valid)
    if len(starts) == 0:
        return empty.astype(np.uint64), empty, empty
    own = anchors[starts]
    new = np.r_[True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(starts)] - 1
    return hashes[own[heads]], starts[heads], starts[tails] + span


def _segments(texts: list[bytes], span: int, size: int = SEGMENT):
    """Texts packed into buffers; gives each buffer with the (text, offset) of its parts."""
    held, parts, length = [], [], 0
    for number, text in enumerate(texts):
        offset = 0
        while len(text) - offset >= span or (offset == 0 and len(text) >= span):
            part = text[offset : offset + size]
            if length + len(part) > size and held:
                yield held, parts
                held, parts, length = [], [], 0
            held.append(part)
            parts.append((number, offset))
            length += len(part)
            if offset + size >= len(text):
                break
            offset += size - span + 1
    if held:
        yield held, parts


def _pieces(texts: list[bytes], span: int, gram: int):
    for held, parts in _segments(texts, span):
        data = np.frombuffer(b"".join(held), dtype=np.uint8)
        bounds = np.r_[0, np.cumsum([len(p) for p in held])]
        hashes, starts, ends = pieces_of(data, bounds, span, gram)
        if len(hashes):
            inside = np.searchsorted(bounds, starts, side="right") - 1
            yield data, bounds, parts, hashes, starts, ends, inside


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that few texts are copied at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _encoded(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _anchor_hashes(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            for _, _, _, hashes, _, _, _ in _pieces(_encoded(batch.column("text")), span, gram):
                found, counts = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view("<i8")), pa.array(counts.astype(np.int64))], names=["h", "n"]
                )

    return run


def _passes(filter_bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(filter_bits) * 8 - 1)
    return (filter_bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _runs(starts: Iterable[int], ends: Iterable[int]) -> list[tuple[int, int]]:
    """Union of intervals."""
    merged: list[list[int]] = []
    for start, end in sorted(zip(starts, ends)):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(s, e) for s, e in merged]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
    kinds = {"kind": pa.int32(), "length": pa.int32(), "multi": pa.int32()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds.get(name, pa.int64())) for name, c in zip(_NAMES, columns)], names=_NAMES
    )


def _candidates(known, span: int, gram: int):
    """Pieces with a possibly repeated anchor; those repeated inside the batch become marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known.value, dtype=np.uint8)
        for batch in _sliced(batches):
            ids, digests = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
            for data, bounds, parts, hashes, starts, ends, inside in _pieces(
                _encoded(batch.column("text")), span, gram
            ):
                keep = _passes(bits, hashes)
                signed, buffer = hashes.view("<i8"), data.tobytes()
                seen: dict[tuple, list] = {}
                marks: dict[int, list[tuple[int, int]]] = {}
                for i in np.flatnonzero(keep).tolist():
                    start, end = int(starts[i]), int(ends[i])
                    digest = xxhash.xxh3_128_intdigest(buffer[start:end])
                    key, row = (int(signed[i]), digest), (int(inside[i]), start, end)
                    other = seen.get(key)
                    if other is None:
                        seen[key] = [row, 0]
                    else:
                        if not other[1]:
                            other[1] = 1
                            marks.setdefault(other[0][0], []).append(other[0][1:])
                        marks.setdefault(row[0], []).append(row[1:])
                rows = []
                for (h, digest), ((text, start, end), multi) in seen.items():
                    number, offset = parts[text]
                    place = start - int(bounds[text]) + offset
                    high, low = _halves(digest)
                    rows.append((CANDIDATE, h, high, low, ids[number], digests[number], place, end - start, multi))
                for text, found in marks.items():
                    number, offset = parts[text]
                    for start, end in _runs(*zip(*found)):
                        place = start - int(bounds[text]) + offset
                        rows.append((MARK, 0, 0, 0, ids[number], digests[number], place, end - start, 1))
                yield _batch(rows)

    return run


def _halves(digest: int) -> tuple[int, int]:
    high, low = digest >> 64, digest & ((1 << 64) - 1)
    return high - ((high >> 63) << 64), low - ((low >> 63) << 64)


# --- equal pieces -----------------------------------------------------------------------------


def _settle(final: bool):
    """Over rows sorted by anchor and digest: mark equal pieces, and pass one of each kind on.

    The state is two rows, however many rows an anchor has. The last step passes on only the
    pieces of anchors that have several different ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = content = held = pending = None
        multi, different = 0, 0
        out: list[tuple] = []

        def mark(row: tuple) -> None:
            out.append((MARK, 0, 0, 0, *row[4:8], 1))

        def close_run() -> None:
            nonlocal pending, different
            if held is None:
                return
            own = (ASK if final else AGAIN, *held[1:8], multi)
            different += 1
            if not final:
                out.append(own)
            elif different == 1:
                pending = own
            else:
                if pending is not None:
                    out.append(pending)
                    pending = None
                out.append(own)

        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in _NAMES)):
                if row[1] != anchor or row[2:4] != content:
                    close_run()
                    if row[1] != anchor:
                        anchor, pending, different = row[1], None, 0
                    content, held, multi = row[2:4], row, row[8]
                else:
                    if not multi:
                        mark(held)
                        multi = 1
                    if not row[8]:
                        mark(row)
            if out:
                yield _batch(out)
                out = []
        close_run()
        yield _batch(out)

    return run


# --- suffix arrays ----------------------------------------------------------------------------


def two_stage_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``data`` in order of their first ``depth`` bytes. Its last byte must be 0.

    Only suffixes smaller than their successors are compared. The others follow from them: a
    scan over the order puts the predecessor of each suffix into the next free place of the
    bucket of its first byte.
    """
    total = len(data)
    step = np.r_[data[1:].astype(np.int16) - data[:-1], np.int16(1)]
    nearest = np.where(step != 0, np.arange(total), total - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    smaller = step[nearest] > 0
    padded = data.tobytes() + bytes(depth)
    direct = np.flatnonzero(smaller)
    pairs = data[direct].astype(np.int64) << 8 | np.r_[data[1:], np.uint8(0)][direct]
    placed = np.argsort(pairs, kind="stable")
    direct, pairs = direct[placed], pairs[placed]
    cuts = np.flatnonzero(np.diff(pairs)) + 1
    for start, end in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(direct)].tolist()):
        if end - start > 1:  # only one bucket of keys is in memory
            bucket = direct[start:end].tolist()
            bucket.sort(key=lambda i: padded[i + 2 : i + depth])
            direct[start:end] = bucket
    sizes = np.bincount(data, minlength=256)
    ends = np.cumsum(sizes)
    order = np.empty(total, dtype=np.int64)
    heads = data[direct]
    per = np.bincount(heads, minlength=256)
    first = np.r_[0, np.cumsum(per)[:-1]]
    order[(ends - per)[heads] + np.arange(len(direct)) - first[heads]] = direct
    free = ends - sizes
    begin = free.copy()
    for byte in np.flatnonzero(sizes):
        level = order[begin[byte] : free[byte]]
        while len(level):  # runs of one byte, one length after the other
            level = level[level > 0] - 1
            level = level[data[level] == byte]
            order[free[byte] : free[byte] + len(level)] = level
            free[byte] += len(level)
        before = order[begin[byte] : ends[byte]]
        before = before[before > 0] - 1
        before = before[data[before] > byte]
        into = data[before]
        sorted_into = np.argsort(into, kind="stable")
        before, into = before[sorted_into], into[sorted_into]
        counts = np.bincount(into, minlength=256)
        ranks = np.arange(len(into)) - np.r_[0, np.cumsum(counts)[:-1]][into]
        order[free[into] + ranks] = before
        free += counts
    return order


def _long_prefix(data: np.ndarray, left: np.ndarray, right: np.ndarray, span: int) -> np.ndarray:
    """Whether the common prefix of each pair of suffixes has ``span`` bytes."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    alive = np.arange(len(left))
    for at in [*range(0, span - 7, 8), span - 8]:
        words = np.lib.stride_tricks.as_strided(padded.view(), (len(data), 8), (1, 1))
        same = (words[left[alive] + at] == words[right[alive] + at]).all(axis=1)
        alive = alive[same]
        if not len(alive):
            break
    found = np.zeros(len(left), dtype=bool)
    found[alive] = True
    return found


def repeated_windows(texts: list[bytes], span: int) -> list[np.ndarray]:
    """For each text, where windows begin that also begin somewhere else in the texts."""
    parts = [np.frombuffer(t, np.uint8) + np.uint8(1) for t in texts]  # UTF-8 has no byte 255
    lengths = np.array([len(p) for p in parts])
    data = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.uint8))])
    bounds = np.r_[0, np.cumsum(lengths + 1)]
    windows = np.zeros(len(data), dtype=bool)
    for begin, length in zip(bounds[:-1], lengths):
        windows[begin : begin + max(0, length - span + 1)] = True
    order = two_stage_order(data, span)
    order = order[windows[order]]
    again = np.zeros(len(data), dtype=bool)
    if len(order) > 1:
        same = _long_prefix(data, order[:-1], order[1:], span)
        again[order[:-1][same]] = True
        again[order[1:][same]] = True
    return [np.flatnonzero(again[b : b + n]) for b, n in zip(bounds[:-1], lengths)]


def _marks_of(row: tuple, at: np.ndarray, span: int) -> list[tuple]:
    if row[8] or not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > span) + 1
    begins, ends = at[np.r_[0, cuts]], at[np.r_[cuts - 1, len(at) - 1]] + span
    return [(MARK, 0, 0, 0, row[4], row[5], row[6] + int(b), int(e - b), 1) for b, e in zip(begins, ends)]


def _digests(row: tuple, span: int) -> Iterator[tuple]:
    text = row[9]
    for at in range(len(text) - span + 1):
        high, low = _halves(xxhash.xxh3_128_intdigest(text[at : at + span]))
        yield (ASK, 0, high, low, row[4], row[5], row[6] + at, span, row[8])


def _compare(span: int, chunk: int):
    """Over pieces sorted by anchor: marks from suffix arrays; digests of windows for large anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []  # of one anchor
        ready: list[tuple] = []  # whole anchors
        sizes, anchor, large = {"group": 0, "ready": 0}, None, False
        out: list[tuple] = []

        def windows(rows: list[tuple]) -> None:
            for row in rows:
                out.extend(_digests(row, span))

        def flush() -> None:
            if ready:
                for row, at in zip(ready, repeated_windows([r[9] for r in ready], span)):
                    out.extend(_marks_of(row, at, span))
            ready.clear()
            sizes["ready"] = 0

        def close() -> None:
            if not large:
                if sizes["ready"] + sizes["group"] > chunk:
                    flush()
                ready.extend(group)
                sizes["ready"] += sizes["group"]
            group.clear()
            sizes["group"] = 0

        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in [*_NAMES, "piece"])):
                if row[1] != anchor:
                    close()
                    anchor, large = row[1], False
                group.append(row)
                sizes["group"] += len(row[9]) + 1
                if sizes["group"] > chunk:
                    large = True
                if large:
                    windows(group)
                    group.clear()
                    sizes["group"] = 0
                if len(out) > 20_000:
                    yield _batch(out)
                    out.clear()
        close()
        flush()
        yield _batch(out)

    return run


# --- the operator -----------------------------------------------------------------------------


def _possibly(known, hashes):
    """Whether a 64-bit hash may be in a filter; only the hashes go to Python."""

    @F.pandas_udf(T.BooleanType())
    def passes(values: pd.Series) -> pd.Series:
        bits = np.frombuffer(known.value, dtype=np.uint8)
        return pd.Series(_passes(bits, values.to_numpy(dtype="<i8").view("<u8")))

    return passes(hashes)


def _filter_of(repeated: DataFrame, size: int) -> bytes:
    """A bit set of ``size`` bits with the hashes in ``h``."""
    part_bits = size // FILTER_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column("h").to_numpy(zero_copy_only=False).view("<u8") & np.uint64(size - 1)
            parts = (slots // np.uint64(part_bits)).astype(np.int64)
            for part in np.unique(parts):
                inside = (slots[parts == part] % np.uint64(part_bits)).astype(np.int64)
                bits = held.setdefault(int(part), np.zeros(part_bits, dtype=np.uint8))
                bits[inside] = 1
        for part, bits in held.items():
            packed = np.packbits(bits, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([packed], pa.binary())], ["p", "b"])

    slot = F.pmod("h", F.lit(size))
    dealt = repeated.select("h", F.floor(slot / part_bits).alias("p")).repartition("p").select("h")
    whole, length = bytearray(size // 8), part_bits // 8
    for row in dealt.mapInArrow(run, "p long, b binary").collect():  # at most FILTER_PARTS rows of fixed size
        whole[row.p * length : (row.p + 1) * length] = row.b
    return bytes(whole)


def repeated_spans(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, chunk: int = CHUNK
) -> DataFrame:
    """``(doc_id, th, spans)`` of the texts that hold a ``span``-byte string which starts twice.

    ``spans`` are the merged byte ranges ``(start, end)`` covered by such strings, in UTF-8. A
    second start in the same text counts and may overlap the first; matches never cross texts.
    ``th`` is ``xxhash64(text)`` and tells apart different texts under one id; repeated rows are
    copies of each other. NULL texts are empty, texts shorter than ``span`` have no spans, a
    NULL id is an id like any other, and an empty table gives no rows.
    """
    if not 8 <= gram < span:
        raise ValueError("gram must be at least 8 and less than span")
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")
    ).filter(F.octet_length("text") >= span)
    counts = slim.select("text").mapInArrow(_anchor_hashes(span, gram), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    repeated = checkpointed(counts.filter("n > 1"))
    total = repeated.agg(F.sum("n")).first()[0] or 0
    heavy = [r.h for r in repeated.filter(F.col("n") > max(SALTS, total // HEAVY_PARTS)).select("h").limit(HEAVY_PARTS).collect()]
    known = spark.sparkContext.broadcast(_filter_of(repeated, FILTER_BITS))
    rows = checkpointed(slim.mapInArrow(_candidates(known, span, gram), ROW))
    known.destroy()  # the driver and every executor have a file of it
    is_heavy = F.col("h").isin(heavy) if heavy else F.lit(False)
    candidates = rows.filter(F.col("kind") == CANDIDATE)

    def settled(frame: DataFrame, keys: list, final: bool) -> DataFrame:
        return frame.repartition(*keys).sortWithinPartitions("h", "c1", "c2").mapInArrow(_settle(final), ROW)

    light = settled(candidates.filter(~is_heavy), ["h"], True)
    marks = rows.filter(F.col("kind") == MARK)
    if heavy:
        salt = F.pmod(F.xxhash64("doc_id", "th", "start"), F.lit(SALTS))
        first = checkpointed(settled(candidates.filter(is_heavy), ["h", salt], False))
        light = light.union(settled(first.filter(F.col("kind") == AGAIN), ["h"], True))
        marks = marks.union(first.filter(F.col("kind") == MARK))
    done = checkpointed(light)
    marks = marks.union(done.filter(F.col("kind") == MARK))
    compared = _compared(slim, done.filter(F.col("kind") == ASK), span, chunk)
    marks = marks.union(compared.filter(F.col("kind") == MARK)).union(
        _equal_windows(compared.filter(F.col("kind") == ASK), span)
    )
    lists = marks.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    return lists.withColumn("spans", _merge("spans"))


def _compared(slim: DataFrame, asks: DataFrame, span: int, chunk: int) -> DataFrame:
    """Fetch the bytes of the pieces and compare them, anchor by anchor."""
    lists = asks.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*_NAMES)).alias("asks")).select(
        F.col("doc_id").alias("ask_id"), F.col("th").alias("ask_th"), "asks"
    )
    known = slim.sparkSession.sparkContext.broadcast(_filter_of(asks.select(F.col("th").alias("h")).distinct(), TEXT_BITS))
    asked = slim.filter(_possibly(known, F.col("th")))  # other texts need not be moved
    joined = asked.join(lists, (slim.th == lists.ask_th) & slim.doc_id.eqNullSafe(lists.ask_id))
    joined = joined.withColumn("data", F.col("text").cast("binary"))
    fields = ", ".join(f"a.{name} AS {name}" for name in _NAMES)
    cut = f"transform(asks, a -> struct({fields}, substring(data, int(a.start) + 1, a.length) AS piece))"
    sliced = joined.select(F.explode(F.expr(cut)).alias("a")).select("a.*")
    dealt = sliced.repartition("h").sortWithinPartitions("h")
    compared = checkpointed(dealt.mapInArrow(_compare(span, chunk), ROW))
    known.destroy()
    return compared


def _equal_windows(windows: DataFrame, span: int) -> DataFrame:
    """Windows of large anchors that occur twice, by 128-bit digests combined before the shuffle."""
    twice = (
        windows.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("multi").alias("m")).filter("n > 1 OR m > 0")
    ).select("c1", "c2")
    return windows.join(twice, ["c1", "c2"]).select(*_NAMES)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@F.pandas_udf(SPANS)
def _merge(lists: pd.Series) -> pd.Series:
    return pd.Series(
        [
            [{"start": s, "end": e} for s, e in _runs([x["start"] for x in row], [x["start"] + x["length"] for x in row])]
            for row in lists
        ]
    )


def with_repeated_spans(
    docs: DataFrame,
    name: str,
    *,
    kept: tuple[str, Callable[[Column, Column], Column], Callable[[Column], Column]] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    **how,
) -> DataFrame:
    """All rows and columns of ``docs``, with the spans of their texts (NULL if there are none).

    ``kept`` adds a column: its name, what makes it of text and spans, and what makes it of a text
    without spans. Only rows whose text may have spans, by a filter of fixed size, are moved to
    meet them, and only these go through the former.
    """
    found = checkpointed(repeated_spans(docs, doc_id=doc_id, text=text, **how))
    known = docs.sparkSession.sparkContext.broadcast(_filter_of(found.select(F.col("th").alias("h")).distinct(), TEXT_BITS))
    found = found.select(
        F.col("doc_id").alias("__span_id"), F.col("th").alias("__span_th"), F.col("spans").alias("__spans")
    )
    hashed = docs.withColumns({"__th": F.xxhash64(text), "__key": F.col(doc_id).cast("long")})
    hashed = hashed.withColumn("__may", _possibly(known, F.col("__th")))
    some = hashed.filter("__may")
    met = some.join(found, (F.col("__th") == F.col("__span_th")) & F.col("__key").eqNullSafe(F.col("__span_id")), "left")
    none = F.lit(None).cast(found.schema["__spans"].dataType)
    cut, whole = [F.col("__spans").alias(name)], [none.alias(name)]
    if kept is not None:
        cut.append(kept[1](F.col(text), F.col("__spans")).alias(kept[0]))
        whole.append(kept[2](F.col(text)).alias(kept[0]))
    return met.select(*docs.columns, *cut).unionAll(hashed.filter("NOT __may").select(*docs.columns, *whole))


@F.pandas_udf(T.BinaryType())
def kept_bytes(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """The UTF-8 bytes of each text outside of its spans."""
    return pd.Series([_outside((t or "").encode("utf-8"), s) for t, s in zip(texts, spans)])


@F.pandas_udf(T.StringType())
def kept_text(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Each text without its spans; a character that a span covers in part stays whole."""
    out = []
    for text, found in zip(texts, spans):
        if text is None or found is None or not len(found):
            out.append(text)
            continue
        data = text.encode("utf-8")
        whole = []
        for span in found:
            start, end = int(span["start"]), int(span["end"])
            while start < end and data[start] & 0xC0 == 0x80:
                start += 1
            while end < len(data) and end > start and data[end] & 0xC0 == 0x80:
                end -= 1
            whole.append({"start": start, "end": end})
        out.append(_outside(data, whole).decode("utf-8"))
    return pd.Series(out)


def _outside(data: bytes, spans) -> bytes:
    if spans is None or not len(spans):
        return data
    kept, at = [], 0
    for span in spans:
        kept.append(data[at : int(span["start"])])
        at = int(span["end"])
    return b"".join([*kept, data[at:]])
