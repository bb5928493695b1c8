from __future__ import annotations

import hashlib
import heapq
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barrelbook.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def after(state, initial):
    return {"": state}.get(initial, {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, state)))


def cheapest(rows):
    """Dijkstra over (rows done, last role), by cost and then by the initials."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, place, state, written = heapq.heappop(heap)
        if place == len(rows) and state in (0, 3):
            return cost, audit, written
        if (place, state) in done:
            continue
        done.add((place, state))
        need = "assistant" if state == 2 else "user"
        to = after(state, need[0])
        heapq.heappush(heap, (cost + 2, audit + "I", place, to, (*written, f"{need}:")))
        if place < len(rows):
            role, text, fault = rows[place]
            heapq.heappush(heap, (cost + 3, audit + "D", place + 1, state, written))
            if fault in ("blank", "duplicate"):
                continue
            cut = int(fault == "truncated")
            kept = after(state, role[:1])
            if kept is not None:
                heapq.heappush(heap, (cost + cut, audit + "K", place + 1, kept, (*written, f"{role}:{text}")))
            heapq.heappush(heap, (cost + cut + 2, audit + "R", place + 1, to, (*written, f"{need}:{text}")))


def expected(rows):
    found = {}
    for conv_id in {r[0] for r in rows}:
        own = [r for r in damaged(rows) if r[0] == conv_id]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faulty = set(), []
        for _, _, role, text in own:
            last = text.rstrip(SPACE)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, written = cheapest(faulty)
        kinds = [f for _, _, f in faulty]
        found[conv_id] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *[kinds.count(x) for x in ("blank", "duplicate", "truncated")],
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(written).encode()).hexdigest(),
        )
    return found


def result(frame):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [(r.conv_id, tuple(r[n] for n in names)) for r in conversations.repaired_digests(frame).collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


@settings(max_examples=400, deadline=None)
@given(st.text("ABCDEFGHIJKLMNO", max_size=14), st.integers(1, 6))
def test_the_auction_finds_the_cheapest_edits_in_blocks_of_any_size(letters, block):
    roles = {"s": "system", "u": "user", "a": "assistant", "": "", "other": "tool"}
    rows = []
    for letter in letters:
        initial, fault = conversations._parts(letter)
        rows.append((roles[initial], "x", {"drop": "blank"}.get(fault, fault)))
    cost, audit, written = cheapest(rows)
    assert conversations.cheapest_edits(letters, block) == (cost, audit)
    edits = list(conversations.edits_of(letters, audit))
    said = [f"{role or rows[row - 1][0]}:{'' if edit == 'I' else 'x'}" for row, edit, role in edits]
    assert tuple(said) == written


def some_rows(seed, conversations_=40):
    pick = random.Random(seed)
    rows = []
    for conv_id in [*range(conversations_), None]:
        for turn in range(pick.randint(1, 9)):
            role = pick.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            text = pick.choice(["Yes.", "No!", "cut off", " \n", "", "é?", "Ende.\t ", None, "a" * 3000 + "."])
            rows.append((conv_id, pick.choice([turn, turn, turn, None, turn + 3]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_as_by_brute_force(spark, seed):
    rows = some_rows(seed)
    assert result(frame(spark, rows)) == expected(rows)


def test_a_conversation_with_most_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 64)
    pick = random.Random(4)
    rows = [(7, t, pick.choice(["user", "assistant", "system"]), pick.choice(["Yes.", f"turn {t}.", "cut"])) for t in range(1500)]
    rows += [(8, 0, "user", "A.")]
    assert result(frame(spark, rows, 8)) == expected(rows)


def test_all_rows_of_a_conversation_are_dropped(spark):
    turn = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert result(frame(spark, [(1, turn, "user", "Hi.")])) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == {}


def test_turns_and_columns_with_clashing_names(spark, clashing):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "cut"), (2, 5, "user", "B."), (2, 6, "assistant", "B.")]
    given_rows = clashing(spark.createDataFrame(rows, SCHEMA))
    found = conversations.repair(given_rows, given_rows)
    turns = sorted((r.conv_id, r.number, r.role, r.text, r.edit, r.turn) for r in found.turns.collect())
    plans = {r.conv_id: (r.cost, r.audit) for r in found.plans.collect()}
    cost, audit, written = cheapest([("assistant", "A.", ""), ("user", "cut", "truncated")])
    assert plans == {1: (cost, audit), 2: (0, "KK")}
    assert [f"{t[2]}:{t[3]}" for t in turns if t[0] == 1] == list(written)
    assert [t[2:] for t in turns if t[0] == 2] == [("user", "B.", "K", 5), ("assistant", "B.", "K", 6)]
