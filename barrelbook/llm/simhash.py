"""SimHash near-duplicates: generalised pigeonhole search over 64-bit fingerprints.

Fingerprints that differ in at most ``distance`` bits are linked. The bits are dealt into groups
of correlated bits; each group gets a threshold of its own, and by the generalised pigeonhole
principle thresholds that sum to ``distance - groups + 1`` lose no pair. A dynamic programme
picks them by the number of candidates that a sample predicts. Only the plan comes from the
sample; every fingerprint is indexed, probed and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrelbook.llm.graph import SALTS, components
from barrelbook.session import bounded_batches, checkpointed

BITS = 64
#: Fingerprints that are read to plan the groups; the search itself covers all of them.
SAMPLE = 2_000
#: Members of a bucket that are compared pair by pair. Larger buckets take the exact way below.
BUCKET = 256


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """SimHash of the word shingles of a text; 0 for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    size = words_per_shingle
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 65_536):
        part = hashes[start : start + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes)))


def with_fingerprint(docs: DataFrame, text: str, name: str, words_per_shingle: int = 3) -> DataFrame:
    """``docs`` with the fingerprint of a text column as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = np.fromiter((fingerprint(t, words_per_shingle) for t in batch), dtype="<u8", count=len(batch))
            yield pd.Series(found.view("<i8"))

    bounded_batches(docs.sparkSession)
    return docs.withColumn(name, fingerprints(F.col(text)))


@dataclass(frozen=True)
class Group:
    """Bits that are probed together, and how many of them may differ (-1: never probed)."""

    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _correlated_groups(bits: np.ndarray, groups: int) -> list[tuple[int, ...]]:
    """Deal the bit columns into equal groups, each grown around its strongest correlation."""
    spread = bits - bits.mean(axis=0)
    norm = np.sqrt((spread**2).sum(axis=0))
    norm[norm == 0] = 1
    strength = np.abs(spread.T @ spread / np.outer(norm, norm))
    np.fill_diagonal(strength, -1)
    free, dealt = list(range(BITS)), []
    for left in range(groups, 0, -1):
        size = -(-len(free) // left)
        inside = strength[np.ix_(free, free)]
        own = [free[int(inside.max(axis=1).argmax())]]
        while len(own) < size:
            rest = [b for b in free if b not in own]
            own.append(rest[int(strength[np.ix_(rest, own)].mean(axis=1).argmax())])
        free = [b for b in free if b not in own]
        dealt.append(tuple(sorted(own)))
    return dealt


def _cost_table(bits: np.ndarray, group: tuple[int, ...], distance: int, total: int) -> list[float]:
    """Rows and predicted candidates of a group under the thresholds -1 (none) to ``distance``."""
    part = bits[:, list(group)].astype(np.float32)
    ones = part.sum(axis=1)
    apart = ones[:, None] + ones[None, :] - 2 * (part @ part.T)
    near = [max(0, int((apart <= t).sum()) - len(part)) for t in range(distance + 1)]
    pairs = max(1, len(part) * (len(part) - 1))
    # A sample without any such pair still allows about one in as many pairs as it has.
    share = [max(n, 1) / pairs for n in near]
    # Evenly spread bits are the least that any table has.
    even = [sum(comb(len(group), j) for j in range(t + 1)) / 2.0 ** len(group) for t in range(distance + 1)]
    rows = [sum(comb(len(group), j) for j in range(t + 1)) for t in range(distance + 1)]
    return [0.0] + [
        (float(total) * rows[t] if t else float(total)) + max(share[t] if near[t] else 0, even[t]) * total * total
        for t in range(distance + 1)
    ]


def plan_groups(sample: np.ndarray, total: int, distance: int, max_groups: int = 4) -> list[Group]:
    """Groups and thresholds of the least predicted cost.

    Thresholds may be unequal, and a group with -1 is left out; all sum to
    ``distance - groups + 1``, which is what keeps every pair within ``distance``.
    """
    if len(sample) == 0:
        sample = np.zeros(1, dtype="<u8")
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    best: tuple[float, list[Group]] | None = None
    for count in range(2, max_groups + 1):
        dealt = _correlated_groups(bits, count)
        costs = [_cost_table(bits, group, distance, total) for group in dealt]
        target = distance - count + 1
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for table in costs:
            grown: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (cost, chosen) in states.items():
                for threshold in range(-1, distance + 1):
                    key, price = used + threshold, cost + table[threshold + 1]
                    if key not in grown or price < grown[key][0]:
                        grown[key] = (price, (*chosen, threshold))
            states = grown
        price, chosen = states[target]
        if best is None or price < best[0]:
            best = (price, [Group(g, t) for g, t in zip(dealt, chosen)])
    return best[1]


def _entries(prints: DataFrame, groups: list[Group]) -> DataFrame:
    """``(part, key, fp)``: every fingerprint under its own bits, and under those it may differ by."""
    made = None
    for number, group in enumerate(groups):
        if group.threshold < 0:
            continue
        flips = [0]
        for size in range(1, group.threshold + 1):
            flips += _flips(group.bits, size)
        own = F.col("fp").bitwiseAND(F.lit(group.mask))
        key = own if flips == [0] else F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: own.bitwiseXOR(x)))
        part = prints.select(F.lit(number).alias("part"), key.alias("key"), "fp")
        made = part if made is None else made.union(part)
    return made


def _flips(bits: tuple[int, ...], size: int) -> list[int]:
    if size == 1:
        return [_signed(1 << b) for b in bits]
    return [_signed((1 << a) | (1 << b)) for i, a in enumerate(bits) for b in bits[:i]]


def _stars(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a small bucket: each member with the smallest one it reaches inside."""
    members = np.unique(members)
    near = np.bitwise_count((members[:, None] ^ members[None, :]).view("<u8")) <= distance
    label = np.arange(len(members))
    while True:
        least = np.where(near, label[None, :], len(members)).min(axis=1)
        if (least == label).all():
            break
        label = least
    return [(int(m), int(members[r])) for m, r in zip(members, label) if members[r] != m]


def _verify(distance: int, bucket: int):
    """Read sorted entries; give verified links, and fingerprints of buckets left open (root NULL)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, held, overflow, first = None, None, np.empty(0, "<i8"), False, True

        def close(edge: bool, out: list[tuple[int, int | None]]) -> None:
            nonlocal held, overflow
            if overflow or edge:
                out += [(int(x), None) for x in np.unique(held)]
            elif len(held) > 1:
                out += _stars(held, distance)
            held, overflow = np.empty(0, "<i8"), False

        for batch in batches:
            if batch.num_rows == 0:
                continue
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (keys[1:] != keys[:-1])) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(keys)]
            out: list[tuple[int, int | None]] = []
            last = len(starts) - 1
            alone = (ends - starts) == 1
            for i in np.flatnonzero(~alone | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == last)):
                start, end = int(starts[i]), int(ends[i])
                if (parts[start], keys[start]) != (part, key) or part is None:
                    if part is not None:
                        close(first, out)
                        first = False
                    part, key = parts[start], keys[start]
                elif i:
                    raise AssertionError("entries are not sorted")
                held = np.concatenate([held, prints[start:end]])
                if len(held) > bucket:
                    overflow = True
                if overflow:  # nothing of a large bucket is kept in memory
                    out += [(int(x), None) for x in np.unique(held)]
                    held = np.empty(0, "<i8")
            yield _links(out)
        out = []
        close(True, out)
        yield _links(out)

    return run


def _links(rows: list[tuple[int, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["a", "b"]
    )


def _through_neighbours(prints: DataFrame, distance: int) -> DataFrame:
    """Exact links of the members of large or cut buckets, without comparing pairs.

    Two fingerprints are within ``2 r`` bits exactly if some value is within ``r`` bits of both.
    Each one names all values within ``r`` bits, so a value is named by at most as many
    fingerprints as it has such neighbours (65 for ``r = 1``): the lists are bounded. An odd
    distance takes the next even ball and verifies inside the list.
    """
    radius = (distance + 1) // 2
    flips = [0]
    for size in range(1, radius + 1):
        flips += _flips(tuple(range(BITS)), size)
    named = prints.select(
        F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: F.col("fp").bitwiseXOR(x))).alias("value"), "fp"
    )
    lists = named.groupBy("value").agg(F.collect_set("fp").alias("near")).filter(F.size("near") > 1)
    if distance == 2 * radius:
        return lists.select(F.explode("near").alias("a"), F.array_min("near").alias("b")).filter("a <> b")
    one = lists.select(F.explode("near").alias("a"), "near").select("a", F.explode("near").alias("b"))
    return one.filter((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))


def link_classes(prints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints ``(fp)`` to ``(node, root)`` of those with a neighbour."""
    if not 0 <= distance <= 4:
        raise ValueError("distance must be between 0 and 4")
    total = prints.count()
    rows = prints.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    groups = plan_groups(np.array([r.fp for r in rows], dtype="<i8").view("<u8"), total, distance)
    entries = _entries(prints, groups)
    dealt = entries.repartitionByRange("part", "key", "fp").sortWithinPartitions("part", "key", "fp")
    found = checkpointed(dealt.mapInArrow(_verify(distance, bucket), "a long, b long"))
    still_open = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    links = found.filter("b is not null").union(_through_neighbours(still_open, distance))
    return components(links)


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    words_per_shingle: int = 3,
    distance: int = 2,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per document: ``doc_id, th, fingerprint, component_id, component``.

    ``fingerprint`` has 16 hex digits, ``component_id`` is the smallest id reachable over links,
    ``component`` a number of the component and ``th`` is ``xxhash64(text)``. Copies share a
    fingerprint, so they meet as one row of the distinct table and are never paired. A NULL text
    counts as empty; texts without words have fingerprint zero and are linked like any other.
    Repeated rows stay repeated. A NULL id names a component only if it has no other (then
    ``component_id`` is NULL). An empty table gives no rows; other columns are not looked at.
    """
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")
    )
    marked = checkpointed(with_fingerprint(slim, "text", "fp", words_per_shingle).select("doc_id", "th", "fp"))
    # Copies share a fingerprint and its links a component: both meet what belongs to them by salts as well.
    marked = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)))
    prints = checkpointed(
        marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.collect_set("salt").alias("salts"))
    )
    classes = link_classes(prints.select("fp"), distance, bucket)
    rooted = prints.join(classes, prints.fp == classes.node, "left").select(
        "fp", "least", "salts", F.coalesce("root", "fp").alias("component")
    )
    rooted = rooted.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    owners = rooted.groupBy("component").agg(F.min("least").alias("component_id"), F.collect_set("part").alias("parts"))
    owners = owners.select("component", "component_id", F.explode("parts").alias("part"))
    owned = rooted.join(owners, ["component", "part"]).select("fp", "component_id", "component", F.explode("salts").alias("salt"))
    return marked.join(owned, ["fp", "salt"]).select(
        "doc_id", "th", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component"
    )
