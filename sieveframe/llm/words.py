"""Words of whole texts as arrays: the shared inner loop of the Arrow operators.

A word is a run of characters other than U+0020 and U+0009 to U+000D. Nothing here depends on how rows
are cut into batches: every text is seen whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 8 << 20


@dataclass
class Words:
    """All words of some texts: ``vocabulary[codes[i]]`` is a word of text ``owners[i]``."""

    texts: int
    owners: np.ndarray
    codes: np.ndarray
    vocabulary: pa.StringArray

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each entry of the vocabulary."""
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocabulary.to_pylist()), np.uint64,
                           len(self.vocabulary))

    def counts(self) -> np.ndarray:
        return np.bincount(self.owners, minlength=self.texts)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes (one text may hold more)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    parts = np.cumsum(sizes, dtype=np.int64) // limit
    starts = np.flatnonzero(np.diff(parts, prepend=-1))
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(start, end - start)


def split(texts: pa.Array, lower: bool = True) -> Words:
    """Words of each text, A-Z lower-cased if asked for; a null text has none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    encoded = lists.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy()
    owners = np.repeat(np.arange(len(texts)), np.diff(offsets))
    empty = pc.index(encoded.dictionary, "").as_py()
    if empty >= 0:  # the splitter gives empty strings at the ends
        keep = codes != empty
        codes, owners = codes[keep], owners[keep]
    return Words(len(texts), owners, codes, encoded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows`` (the last may hold fewer), for work by whole arrays."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)
