from __future__ import annotations

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from barrelbook.llm import simhash
from barrelbook.llm.graph import components


def brute_print(text, size=3):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, distance=2):
    """Smallest index reachable over links, by comparing all pairs."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def check(spark, frame, rows):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame).collect())
    rows = sorted(rows)
    prints = [brute_print(t) for _, t in rows]
    classes = brute_classes(prints)
    assert got == sorted((i, f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, classes))


@given(st.text(alphabet="aB \t\n İé", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint_matches_definition(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_near_duplicates_match_brute_force(spark, documents, clashing):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(0, "one two"), (1, None), (2, ""), (3, " \n "), (4, "One TWO"), (5, "x " * 30_000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(10, 70):
        words = list(base) if i < 45 else [rng.choice(vocabulary) for _ in range(40)]
        if 12 <= i < 45:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    check(spark, clashing(documents(rows)), rows)


def test_nulls_repeats_and_empty_table(spark, documents):
    frame = documents([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "q r s t u")])
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame).collect()]
    assert len(got) == 4
    assert sorted(c for i, _, c in got if i == 7) == [7, 7]
    assert sorted(str(c) for i, _, c in got if i is None) == ["7", "None"]
    assert simhash.near_duplicates(documents([])).collect() == []


def test_search_loses_no_link(spark):
    """Dense clusters, chains and cut buckets, with a bucket size that sends most to the exact way."""
    rng = np.random.default_rng(1)
    prints = {0, 1, 3, 2**64 - 1}
    for _ in range(12):
        centre = int(rng.integers(0, 2**63)) * 2
        prints.add(centre)
        for _ in range(25):
            flipped = centre
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                flipped ^= 1 << int(bit)
            prints.add(flipped)
    prints = sorted(prints, key=lambda p: p - (1 << 64) if p >> 63 else p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {}
    for p, c in zip(signed, brute_classes(prints)):
        want[p] = signed[c]
    for bucket in (2, 256):
        frame = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(5)
        got = {r.node: r.root for r in simhash.link_classes(frame, 2, bucket).collect()}
        assert {s: got.get(s, s) for s in signed} == want


def test_plan_keeps_the_pigeonhole_sum():
    rng = np.random.default_rng(3)
    skewed = rng.integers(0, 2**20, 500).astype("<u8")  # 44 bits never change
    for distance in (0, 1, 2, 3, 4):
        for total in (10, 10**6, 10**10):
            groups = simhash.plan_groups(skewed, total, distance)
            assert sorted(b for g in groups for b in g.bits) == list(range(64))
            assert sum(g.threshold for g in groups) == distance - len(groups) + 1
    assert len({g.threshold for g in simhash.plan_groups(skewed, 10**9, 2)}) > 1


def test_odd_distances(spark):
    values = [0, 1, 0b111, 0b1111111, 1 << 40]
    for distance in (1, 3):
        frame = spark.createDataFrame([(v,) for v in values], "fp long").repartition(2)
        got = {r.node: r.root for r in simhash.link_classes(frame, distance, 1).collect()}
        classes = brute_classes(values, distance)
        assert {v: got.get(v, v) for v in values} == {v: values[c] for v, c in zip(values, classes)}


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1_000, 1_000 + i) for i in range(1, 80)] + [(5, 5), (5, 6), (6, 5)]
    frame = spark.createDataFrame(chain + hub, "a long, b long").repartition(4)
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {i: 0 for i in range(61)} | {1_000 + i: 1_000 for i in range(80)}
    assert components(frame.limit(0)).collect() == []
