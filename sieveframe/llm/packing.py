"""Packing token sequences: sum-of-squares placement of documents into windows of fixed length.

Each input partition is packed as it streams by, without a shuffle. A document gives whole windows of
its own and one rest; the rest goes to the fill level ``h`` that makes the sum of squared counts of
partly filled windows least (the level array holds those counts; level 0 opens a window; of equal
choices the fullest wins). Windows still open at the end of a partition, or beyond ``MAX_OPEN`` of them,
are joined end to end and cut anew, and what remains is cut into lengths that are powers of two; so
memory is bounded and nothing is padded.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
END = 1  # the id that ends every document
MAX_OPEN = 4096
ID_BITS = 40  # of a sequence id, below its partition's number

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, ids array<int>")

Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, doc_tokens


@dataclass(frozen=True)
class Vocabulary:
    """One byte-level vocabulary: its ``tokenizers`` file, the same as ranks, and its splitting rule."""

    tokenizer: str
    ranks: str
    pattern: str

    def encoder(self) -> Callable[[str], np.ndarray]:
        """Text to the ids that ``tokenizers`` gives; strings of special tokens are plain text.

        The ranks find the same ids several times as fast (tests compare the two). Their splitter gives
        up on white space of some hundred thousand characters; such a text goes to ``tokenizers``.
        """
        import tiktoken
        from tokenizers import Tokenizer

        with open(self.ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=table, special_tokens={})

        @cache
        def slow() -> Tokenizer:
            tokenizer = Tokenizer.from_file(self.tokenizer)
            tokenizer.encode_special_tokens = True
            return tokenizer

        def encode(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)

        return encode


class Windows:
    """Windows of one partition; ``done`` holds finished ones until they are taken."""

    def __init__(self, length: int = LENGTH, max_open: int = MAX_OPEN):
        self.length, self.max_open = length, max_open
        self.levels = np.zeros(length + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0
        self.done: list[list[Piece]] = []

    def level_for(self, size: int) -> int:
        """The level whose use makes the sum of squared counts least; the fullest of equal ones."""
        used = np.flatnonzero(self.levels[1:self.length - size + 1]) + 1
        after = used + size
        change = 2 * (np.where(after < self.length, self.levels[after] + 1, 0) - self.levels[used])
        change = change + np.where(after < self.length, 0, 1)
        new = 2 * self.levels[size] + 1
        if len(used):
            best = len(used) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= new:
                return int(used[best])
        return 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) - len(ids) % self.length
        for start in range(0, whole, self.length):
            self.done.append([(doc_id, start, ids[start:start + self.length], total)])
        if whole == total:
            return
        size = total - whole
        level = self.level_for(size)
        window: list[Piece] = []
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        window.append((doc_id, whole, ids[whole:], total))
        self._put(window, level + size)
        if self.n_open > self.max_open:
            self.close(last=False)

    def _put(self, window: list[Piece], level: int) -> None:
        if level == self.length:
            self.done.append(window)
            return
        self.levels[level] += 1
        self.n_open += 1
        self.open.setdefault(level, []).append(window)

    def close(self, last: bool = True) -> None:
        """Join the open windows and cut them to full ones; at the end, the rest to powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        self.levels[:], self.open, self.n_open = 0, {}, 0
        left = sum(len(p[2]) for p in pieces)
        window: list[Piece] = []
        room = self._room(left, last)
        for doc_id, start, ids, total in pieces:
            while len(ids):
                cut = ids[:room]
                window.append((doc_id, start, cut, total))
                start, ids, room, left = start + len(cut), ids[len(cut):], room - len(cut), left - len(cut)
                if room == 0:
                    self.done.append(window)
                    window, room = [], self._room(left, last)
        if window:
            self._put(window, sum(len(p[2]) for p in window))

    def _room(self, left: int, last: bool) -> int:
        return self.length if left >= self.length or not last else 1 << max(0, left.bit_length() - 1)


def _rows(windows: list[list[Piece]], first: int, with_ids: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(7)]
    ids: list[np.ndarray] = []
    for number, window in enumerate(windows, first):
        offset = 0
        for doc_id, start, piece, total in window:
            values = (doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), total, number, offset)
            for column, value in zip(columns, values):
                column.append(value)
            ids.append(piece)
            offset += len(piece)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    arrays = [pa.array(column, pa.int64()) for column in columns]
    if with_ids:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, length: int, with_ids: bool
          ) -> Iterator[pa.RecordBatch]:
    encode, windows = vocabulary.encoder(), Windows(length)
    number = TaskContext.get().partitionId() << ID_BITS
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            windows.add(doc_id, np.append(encode(text or ""), np.uint32(END)))
        if windows.done:
            yield _rows(windows.done, number, with_ids)
            number, windows.done = number + len(windows.done), []
    windows.close()
    if windows.done:
        yield _rows(windows.done, number, with_ids)


def pack(docs: DataFrame, vocabulary: Vocabulary, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document of ``docs(doc_id, text)``: where it starts in the document's ids
    and at which offset of which sequence it lies, with its ids if asked for.

    ``length`` must be a power of two. A null text is the empty one, whose only id is ``END``; a null doc_id stays null; repeated rows are packed as often as
    they come. A text's length is not limited: it gives as many windows as it needs. Sequence ids are
    unique and depend on how the input is dealt to tasks; a task that is run again gives them anew.
    """
    schema = PIECES if with_ids else PIECES.rpartition(",")[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_pack, vocabulary=vocabulary, length=length, with_ids=with_ids), schema)
