"""Conversation structure repair: the cheapest edits that make the turns of a conversation legal.

A legal conversation is empty, or an optional system turn followed by pairs of a user and an
assistant turn. A row is kept (0), given the role user or assistant (2) or deleted (3, which blank
and repeated rows require); an empty turn can be inserted anywhere (2). A truncated row that stays
adds 1.

The edits of a conversation are the arcs of a lattice: its nodes are the rows done so far and the
last role written. An auction finds the shortest path. It keeps a price per node, no price above
the cost of an arc plus the price at its end, and a path from the source: where no arc of the last
node meets its price the price rises and the path contracts, else the path extends along the best
arc. The lattice is solved in blocks of rows from the end; the prices of a block's first nodes are
exact and are what leaving the block before it costs. Arcs that meet the price of their node are
tight, every shortest path consists of tight arcs, and of these paths the one whose initials
come first in ASCII is traced from the start.

Rows are ranked in their conversation without gathering it. The lattice needs one letter a row:
only these letters of a conversation meet in one task, as its audit does in one result row. Texts
are joined to the edits by conversation and position.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barrelbook.operators.ranking import rank_within
from barrelbook.session import checkpointed, scratch_path

#: White space of the faults: blank and tab to carriage return.
SPACE = " \t\n\x0b\f\r"
#: Rows whose letters are gathered at a time before a conversation's are joined.
CHUNK = 4096
#: Rows of the lattice solved at a time.
BLOCK = 12

DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: A letter for each row: the class of its role's initial, then its fault.
INITIALS, FAULTS = ("s", "u", "a", "", "other"), ("none", "truncated", "drop")
START, SYSTEM, USER, ASSISTANT = range(4)
#: The node that a role leads to, for each last role written.
AFTER = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
    "": {state: state for state in range(4)},
    "other": {},
}
#: The only legal next turn, for each last role written; and the states a conversation may end in.
TURN = (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def letter_of(initial: int, fault: int) -> str:
    return chr(ord("A") + len(FAULTS) * initial + fault)


def _parts(letter: str) -> tuple[str, str]:
    initial, fault = divmod(ord(letter) - ord("A"), len(FAULTS))
    return INITIALS[initial], FAULTS[fault]


@functools.cache
def _row_arcs(letter: str) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each last role: the arcs over a row as ``(initial of the edit, cost, next role)``."""
    initial, fault = _parts(letter)
    arcs = []
    for state in range(4):
        out = [("D", DELETE, state)]
        if fault != "drop":
            cut = CUT if fault == "truncated" else 0
            if state in AFTER[initial]:
                out.append(("K", cut, AFTER[initial][state]))
            out.append(("R", REROLE + cut, TURN[state]))
        arcs.append(tuple(out))
    return tuple(arcs)


def _arcs(letters: str, place: int, state: int, exits: tuple[int, ...]) -> Iterator[tuple[str, int, int | None, int]]:
    """Arcs of a node in the order of their initials: ``(initial, cost, node or None, last role)``.

    None is a node outside the block, whose price is already part of the cost. In the last block
    there is one place more than rows, and ``exits`` is empty.
    """
    insert = ("I", INSERT, 4 * place + TURN[state], TURN[state])
    if place == len(letters):  # after the last row of all
        if state in ENDS:
            yield ("", 0, None, state)
        yield insert
        return
    row = _row_arcs(letters[place])[state]
    leaves = bool(exits) and place + 1 == len(letters)
    for number, (edit, cost, after) in enumerate(row):
        yield (edit, cost + exits[after], None, after) if leaves else (edit, cost, 4 * (place + 1) + after, after)
        if number == 0:
            yield insert


@functools.lru_cache(maxsize=50_000)
def solve_block(letters: str, exits: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Prices of the four first nodes of a block; and from each the first tight path.

    ``exits`` has the exact prices of the nodes after the block; empty for the last block.
    A path is its initials and the last role when it leaves the block.
    """
    places = len(letters) + (not exits)
    arcs = [list(_arcs(letters, i // 4, i % 4, exits)) for i in range(4 * places)]
    price = [0] * len(arcs)
    for source in range(4):
        path = [source]
        while True:
            node = path[-1]
            best, onward = None, None
            for _, cost, to, _ in arcs[node]:
                total = cost if to is None else cost + price[to]
                if best is None or total < best:
                    best, onward = total, to
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif onward is None:
                break
            else:
                path.append(onward)
    tight = [[a for a in out if price[i] == (a[1] if a[2] is None else a[1] + price[a[2]])] for i, out in enumerate(arcs)]
    leads = [False] * len(arcs)  # to the end of the block, over tight arcs
    for place in reversed(range(places)):
        for _ in range(3):  # insertions stay at their place
            for node in range(4 * place, 4 * place + 4):
                leads[node] = leads[node] or any(to is None or leads[to] for _, _, to, _ in tight[node])
    paths = []
    for node in range(4):
        audit, at, last = [], node, node
        while at is not None:
            edit, _, at, last = next(a for a in tight[at] if a[2] is None or leads[a[2]])
            audit.append(edit)
        paths.append(("".join(audit), last))
    return tuple(price[:4]), tuple(paths)


def cheapest_edits(letters: str, block: int = BLOCK) -> tuple[int, str]:
    """Least cost of the edits of a conversation, and their initials, ASCII-least of equal costs."""
    starts = range(0, len(letters), block) or range(1)
    exits, offset, solved = (), 0, []
    for start in reversed(starts):
        prices, paths = solve_block(letters[start : start + block], exits)
        least = min(prices)
        offset += least
        exits = tuple(p - least for p in prices)
        solved.append(paths)
    state, audit = START, []
    for paths in reversed(solved):
        edits, state = paths[state]
        audit.append(edits)
    return offset + exits[START], "".join(audit)


def illegal_neighbours(letters: str) -> int:
    """Adjacent rows whose roles may not follow each other."""
    initials = [_parts(x)[0] for x in letters]
    return sum(pair not in LEGAL for pair in zip(initials, initials[1:], strict=False))


def edits_of(letters: str, audit: str) -> Iterator[tuple[int, str, str | None]]:
    """What the audit writes: ``(row from 1, initial, new role)``; the row of an insertion is 0."""
    row, state = 0, START
    for edit in audit:
        row += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = AFTER[_parts(letters[row - 1])[0]][state]
            yield row, edit, None
        else:
            state = TURN[state]
            yield 0 if edit == "I" else row, edit, "user" if state == USER else "assistant"


_PLAN = T.StructType(
    [T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType()), T.StructField("audit", T.StringType())]
)


@F.pandas_udf(_PLAN)
def _plans(letters: pd.Series) -> pd.DataFrame:
    found = [(*cheapest_edits(x), illegal_neighbours(x)) for x in letters]
    return pd.DataFrame({"cost": [x[0] for x in found], "illegal": [x[2] for x in found], "audit": [x[1] for x in found]})


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans of conversations to a row per turn that they write."""
    rows: tuple[list, ...] = ([], [], [], [], [])
    kinds = (None, pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["conversation", "number", "position", "edit", "new_role"]

    def flush(kind):
        arrays = [pa.array(values, kind if k is None else k) for values, k in zip(rows, kinds, strict=True)]
        for values in rows:
            values.clear()
        return pa.RecordBatch.from_arrays(arrays, names=names)

    kind = None
    for batch in batches:
        kind = batch.schema.field("conversation").type
        plans = zip(*(batch.column(x).to_pylist() for x in ("conversation", "letters", "audit")), strict=True)
        for conversation, letters, audit in plans:
            for number, (position, edit, role) in enumerate(edits_of(letters, audit), 1):
                for values, value in zip(rows, (conversation, number, position, edit, role), strict=True):
                    values.append(value)
                if len(rows[0]) == 20_000:
                    yield flush(kind)
    if rows[0]:
        yield flush(kind)


@dataclass(frozen=True)
class Repair:
    """``plans``: a row per conversation; ``turns``: the turns that stand after its edits."""

    plans: DataFrame
    turns: DataFrame


def _joined(pieces: Column, number: str, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(pieces), lambda x: x[text]), "")


def _same(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Join on columns of which NULLs are equal."""
    right = right.withColumnsRenamed({name: f"{name}__right" for name in names})
    on = [F.col(name).eqNullSafe(F.col(f"{name}__right")) for name in names]
    return left.join(right, functools.reduce(lambda a, b: a & b, on), how).drop(*[f"{name}__right" for name in names])


def repair(rows: DataFrame, conversations: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text") -> Repair:
    """The faults of every conversation, its cheapest edits and its turns after them.

    Rows are taken by turn, NULL first, rows of one turn by role and text. NULL roles and texts
    count as one blank; a NULL conversation is one like any other. ``conversations`` names all
    that are to be reported, repeated or not: one without rows has zeros and an empty audit. The
    first fault of a row counts: blank, duplicate (role and text stand earlier in its
    conversation) or truncated (its last character that is no white space ends no sentence).
    ``gaps`` are the turn numbers that are missing between the least and the greatest; NULL turns
    do not count. Other columns are left out. Empty tables give empty results.

    ``plans``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``; ``turns``:
    ``conv_id, number, role, text, edit, turn``, with a NULL turn where one was inserted.
    """
    own = rows.select(
        F.col(conv_id).alias("conversation"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    path = scratch_path(rows.sparkSession, "turns")
    rank_within(own, ["conversation"], order, "position").write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    trimmed = F.rtrim("text", F.lit(SPACE))
    facts = placed.select(
        "conversation",
        "position",
        "turn",
        F.left("role", F.lit(1)).alias("initial"),
        (trimmed == "").alias("is_blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("is_cut"),
        # the length keeps role and text apart
        F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256).alias("content"),
    )
    # The first row of each content is one per (conversation, position): no hot key in the join.
    firsts = facts.groupBy("conversation", "content").agg(F.min("position").alias("position"))
    firsts = firsts.select("conversation", "position", F.lit(True).alias("is_first"))
    known = _same(facts.drop("content"), firsts, ["conversation", "position"], "left")
    fault = (
        F.when(F.col("is_blank"), "blank")
        .when(F.col("is_first").isNull(), "duplicate")
        .when(F.col("is_cut"), "truncated")
        .otherwise("none")
    )
    known = known.withColumn("fault", fault)
    drops = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    initial = F.coalesce(
        *[F.when(F.col("initial") == x, i) for i, x in enumerate(INITIALS[:-1])], F.lit(len(INITIALS) - 1)
    )
    letter = F.char(F.lit(ord("A")) + len(FAULTS) * initial + drops)
    counted = [F.sum((F.col("fault") == x).cast("long")).alias(x) for x in ("blank", "duplicate", "truncated")]
    chunks = (
        known.withColumns({"letter": letter, "chunk": F.floor((F.col("position") - 1) / CHUNK)})
        .groupBy("conversation", "chunk")
        .agg(F.collect_list(F.struct("position", "letter")).alias("pieces"), *counted)
        .withColumn("letters", _joined(F.col("pieces"), "position", "letter"))
    )
    named = conversations.select(F.col(conv_id).alias("conversation")).distinct()
    none = [F.lit(None).cast("long").alias("chunk"), F.lit("").alias("letters")]
    zeros = [F.lit(0).cast("long").alias(x) for x in ("blank", "duplicate", "truncated")]
    both = chunks.drop("pieces").unionByName(named.select("conversation", *none, *zeros))
    pieces = F.collect_list(F.struct("chunk", "letters"))
    sums = [F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")]
    plans = both.groupBy("conversation").agg(pieces.alias("pieces"), *sums)
    plans = plans.select("conversation", "blank", "duplicate", "truncated", _joined(F.col("pieces"), "chunk", "letters").alias("letters"))
    turns = facts.select("conversation", "turn").filter("turn IS NOT NULL").distinct()
    gaps = turns.groupBy("conversation").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    plans = _same(plans, gaps, ["conversation"], "left").withColumn("plan", _plans("letters"))
    plans = checkpointed(plans.select("*", "plan.*").drop("plan"))
    kind = rows.schema[conv_id].dataType.simpleString()
    schema = f"conversation {kind}, number long, position long, edit string, new_role string"
    written = plans.select("conversation", "letters", "audit").mapInArrow(_written, schema)
    met = _same(written, placed, ["conversation", "position"], "left")
    result = met.select(
        F.col("conversation").alias(conv_id),
        "number",
        F.coalesce("new_role", "role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        "edit",
        "turn",
    )
    plans = plans.select(
        F.col("conversation").alias(conv_id),
        F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"),
        *["blank", "duplicate", "truncated", "illegal", "cost", "audit"],
    )
    return Repair(plans, result)


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with the damage that a checksum of conversation and turn picks.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes the sentence ends out, 3 repeats
    the row, 4 makes it a user's. NULLs count as one blank, but for the turn that rows are sorted by.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    own = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(name) % 20).alias("kind"))
    kind = F.col("kind")
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return own.filter(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per conversation from its sorted turns, kept open over batches."""
    def result(of, digest, kind):
        return pa.RecordBatch.from_arrays([pa.array([of], kind), pa.array([digest.hexdigest()])], names=["conv_id", "digest"])

    digest = of = kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conversation, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
            if digest is None or conversation != of:
                if digest is not None:
                    yield result(of, digest, kind)
                digest, of = hashlib.sha256(), conversation
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
    if digest is not None:
        yield result(of, digest, kind)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, digest``: SHA-256 over ``role:text`` of the turns, joined by line feeds.

    The turns stream through one task in order, as the hash is sequential; it holds one batch of them.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = turns.select("conv_id", "number", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "number")
    return dealt.mapInArrow(_hashes, f"conv_id {kind}, digest string")


def repaired_digests(rows: DataFrame) -> DataFrame:
    """Damage conversations, repair them, and hash what they have become.

    Conversations of which nothing stands have the hash of the empty string.
    """
    found = repair(damaged(rows), rows)
    empty = hashlib.sha256().hexdigest()
    met = _same(found.plans, digests(found.turns), ["conv_id"], "left")
    return met.withColumn("repaired_sha256", F.coalesce("digest", F.lit(empty))).drop("digest")
