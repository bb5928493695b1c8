"""Sum-of-squares packing of tokenised documents into windows.

A partition is packed online. The state is an array with the number of open windows at every
fill level; a document goes to the level whose choice makes the sum of squared counts smallest,
so that no fill level piles up and windows keep finding documents that fill them. Documents of a
window or more fill whole windows first. What is still open at the end is cut and joined, and the
last rest is dealt to windows whose sizes are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barrelbook.session import bounded_batches

WINDOW = 1_024
#: Open windows that a task keeps; beyond that they are closed like those at the end.
OPEN_WINDOWS = 8_192
END_OF_DOCUMENT = 0
#: White space in a row from which a text is encoded by the whole tokenizer.
LONG_RUN = 100_000
PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long"
)


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Tokens that a tokenizer's JSON file adds to its vocabulary; they are taken whole wherever a text has them."""
    with open(vocabulary, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(token[how] for token in found for how in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take more or less than their own characters are not supported")
    return {token["content"]: token["id"] for token in found}


def byte_pair_encoder(ranks: str, pattern: str, vocabulary: str | None = None) -> Callable[[], Callable[[str], np.ndarray]]:
    """A maker of encoders for a file of ranks and the added tokens of ``vocabulary``, a tokenizer's
    JSON file; files are read where the encoder is used.

    The pattern looks ahead after white space, which the fast encoder can't do over very long runs of
    it; texts with such runs are encoded by the tokenizer of the JSON file itself.
    """

    def make() -> Callable[[str], np.ndarray]:
        import tiktoken
        from tokenizers import Tokenizer

        long_run = re.compile(rf"\s{{{LONG_RUN}}}")
        with open(ranks, "rb") as file:
            merges = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        added = added_tokens(vocabulary) if vocabulary else {}
        encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=merges, special_tokens=added)
        whole: list[Tokenizer] = []  # read when a text needs it

        def encode(text: str) -> np.ndarray:
            if len(text) < LONG_RUN or not long_run.search(text):
                return np.asarray(encoding.encode(text, allowed_special="all"), dtype="<u4")
            if vocabulary is None:
                raise ValueError("a text with a very long run of white space needs the tokenizer's JSON file")
            if not whole:
                whole.append(Tokenizer.from_file(vocabulary))
            return np.asarray(whole[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

        return encode

    return make


class Packer:
    """Open windows of one task. ``done`` holds closed windows: lists of pieces."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.limit = window, open_windows
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]
        self.open, self.done = 0, []

    def add(self, doc, ids: np.ndarray) -> None:
        """Place one document; ``doc`` is passed through to its pieces."""
        start = 0
        while len(ids) - start >= self.window:
            self.done.append([(doc, start, ids[start : start + self.window])])
            start += self.window
        if start < len(ids):
            self._place((doc, start, ids[start:]))
        if self.open > self.limit:
            self.close()

    def _place(self, piece: tuple) -> None:
        size, window = len(piece[2]), self.window
        # Change of the sum of squares if the window at level h becomes one at h + size.
        change = 2 * self.counts[size : window + 1] + 1
        change[-1] = 0  # a full window leaves the array
        change[1:] -= 2 * self.counts[1 : window - size + 1] - 1
        allowed = self.counts[: window - size + 1] > 0
        allowed[0] = True
        change = np.where(allowed, change, np.iinfo(np.int64).max)
        level = len(change) - 1 - int(change[::-1].argmin())  # the fullest of the best
        held = self.levels[level].pop() if level else []
        held.append(piece)
        if level:
            self.counts[level] -= 1
            self.open -= 1
        if level + size == window:
            self.done.append(held)
        else:
            self.levels[level + size].append(held)
            self.counts[level + size] += 1
            self.open += 1

    def close(self) -> None:
        """Close every open window: the emptiest are cut up to fill the fullest."""
        windows = [held for level in reversed(self.levels) for held in level]
        first, last, window = 0, len(windows) - 1, self.window
        sizes = [sum(len(p[2]) for p in held) for held in windows]
        while first < last:
            room = window - sizes[first]
            doc, start, ids = windows[last].pop()
            taken = min(room, len(ids))
            windows[first].append((doc, start + len(ids) - taken, ids[len(ids) - taken :]))
            if taken < len(ids):
                windows[last].append((doc, start, ids[: len(ids) - taken]))
            sizes[first] += taken
            sizes[last] -= taken
            if sizes[first] == window:
                first += 1
            if sizes[last] == 0:
                last -= 1
        self.done += [held for held, size in zip(windows[:first], sizes) if size]
        for held, size in zip(windows[first : last + 1], sizes[first : last + 1]):
            self.done += [held] if size == window else _powers(held, size)
        self.levels = [[] for _ in range(window + 1)]
        self.counts[:] = 0
        self.open = 0


def _powers(pieces: list, size: int) -> list[list]:
    """Cut the pieces of a window into windows whose sizes are powers of two."""
    out, rest = [], list(pieces)
    for bit in reversed(range(size.bit_length())):
        want, held = size & (1 << bit), []
        while want:
            doc, start, ids = rest.pop(0)
            held.append((doc, start, ids[:want]))
            if len(ids) > want:
                rest.insert(0, (doc, start + want, ids[want:]))
            want -= min(want, len(ids))
        if held:
            out.append(held)
    return out


def _rows(windows: list[list], first: int) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(8)]
    for number, held in enumerate(windows):
        offset, size = 0, sum(len(p[2]) for p in held)
        for (doc_id, tokens), start, ids in held:
            values = (doc_id, start, len(ids), ids.tobytes(), tokens, first + number, offset, size)
            for column, value in zip(columns, values):
                column.append(value)
            offset += len(ids)
    names = [field.split()[0] for field in PIECES.split(", ")]
    kinds = [pa.binary() if name == "ids" else pa.int64() for name in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[str], np.ndarray]],
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """Pieces of all documents: which tokens lie where in which sequence.

    A document is its tokens and an end token; a NULL text has the end token only. Every token
    lies in one piece (``start``, ``length``, ``ids`` as little-endian 32-bit integers), and the
    pieces of a sequence follow each other from offset 0. ``sequence_tokens`` is the filled size:
    ``window``, or a power of two for the last sequences of a task, so nothing is padded.
    Sequence ids are unique, not consecutive, and depend on how the table is split. Repeated rows
    and NULL ids are documents of their own; an empty table gives no rows. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(), Packer(window, open_windows)
        number = TaskContext.get().partitionId() << 40
        end = np.array([END_OF_DOCUMENT], dtype="<u4")
        for batch in batches:
            for key, content in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.concatenate([encode(content), end]) if content else end
                packer.add((key, len(ids)), ids)
                if len(packer.done) >= 512:
                    yield _rows(packer.done, number)
                    number += len(packer.done)
                    packer.done = []
        packer.close()
        yield _rows(packer.done, number)

    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, PIECES)
