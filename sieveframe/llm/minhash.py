"""Near-duplicate documents by one-permutation MinHash, optimal densification and star-shaped candidates.

Every text becomes its set of distinct five-word shingles (A-Z lower-cased; fewer words make one
shingle), each known by a 64-bit hash. One sorted pass fills ``BANDS * ROWS`` bins with the least hash
of each; an empty bin copies from a bin drawn by a hash of (bin, attempt), the same for all documents.
Texts with equal sets are one node from then on, so a thousand copies cost no more than one.

Candidates: nodes that share a band's bucket. A bucket gives a star from its least node, so its pairs
grow with its members; all are confirmed on full sets. Where a bucket still holds more than one
component after that, its other members are compared in blocks inside tasks, which emit a spanning
forest of the links they find and never the pairs. A pair at the threshold of 0.85, or of 0.8 under
``AT_80``, is missed by all bands with a probability of about 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveframe.llm.graph import components
from sieveframe.llm.tables import fresh, stored
from sieveframe.llm.words import as_long, mix, slices, split

SHINGLE = 5
BANDS, ROWS = 36, 7
PERCENT = 85

BLOCK = 512  # members of a bucket that one task compares with as many others
COLUMNS = 2048  # shingles at a time in that comparison

SKETCH = "doc_id long, row_key long, n_shingles long, node long, bands array<long>"


@dataclass(frozen=True)
class Threshold:
    """Least similarity of a link, in percent, and the bands that find such pairs."""

    percent: int = PERCENT
    bands: int = BANDS
    rows: int = ROWS


AT_85 = Threshold()
AT_80 = Threshold(80, 48, 6)  # (1 - 0.8 ** 6) ** 48 is 5e-7


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; empty without words."""
    words = split(texts)
    hashes = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    counts = words.counts()
    ends = np.cumsum(counts)
    full = max(0, len(hashes) - size + 1)
    rolled = hashes[:full].copy()
    for k in range(1, size):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + full])
    sets = []
    for start, end in zip(ends - counts, ends):
        if end - start >= size:
            sets.append(np.unique(rolled[start:end - size + 1]))
        elif end > start:  # the whole short sequence is one shingle
            key = xxhash.xxh3_64_intdigest(hashes[start:end].tobytes(), seed=int(end - start))
            sets.append(np.array([key], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` minima per set; empty bins are filled by optimal densification."""
    limits = np.array([(k << 64) // bins for k in range(bins)], np.uint64)
    out = np.zeros((len(sets), bins), np.uint64)
    empty = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, limits)
            empty[i] = at == np.append(at[1:], len(s))
            out[i] = s[np.minimum(at, len(s) - 1)]
    filled = ~empty
    row, column = np.nonzero(empty)
    attempt = 0
    while len(row):
        attempt += 1
        drawn = mix(column.astype(np.uint64) + np.uint64(attempt << 32)) % np.uint64(bins)
        drawn = drawn.astype(np.int64)
        hit = filled[row, drawn]
        out[row[hit], column[hit]] = out[row[hit], drawn[hit]]
        row, column = row[~hit], column[~hit]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def _sketch(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            keys = band_keys(signatures(sets, bands * rows), bands, rows)
            lengths = np.array([len(s) for s in sets])
            keys = as_long(keys[lengths > 0])
            offsets = np.concatenate([[0], np.cumsum(np.where(lengths > 0, bands, 0))])
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("row_key"), pa.array(lengths, pa.int64()),
                pa.array(as_long(nodes), mask=lengths == 0),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel())),
            ], ["doc_id", "row_key", "n_shingles", "node", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            yield pa.RecordBatch.from_arrays([
                part.column("node"),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(as_long(np.concatenate(sets)))),
            ], ["node", "shingles"])


def close(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of a left and a right set have at least ``percent`` similarity, as a boolean matrix."""
    sizes = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    values, ids = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owners = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    shared = np.bincount(ids)[ids] > 1
    values, ids = np.unique(ids[shared], return_inverse=True)
    order = np.argsort(ids, kind="stable")
    ids, owners = ids[order], owners[shared][order]
    both = np.zeros((len(left), len(right)))
    for first in range(0, len(values), COLUMNS):
        low, high = np.searchsorted(ids, [first, first + COLUMNS])
        block = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        block[owners[low:high], ids[low:high] - first] = 1
        both += block[:len(left)] @ block[len(left):].T
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def forest(matrix: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of the matrix, as pairs of the given names."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for i, j in zip(*np.nonzero(matrix)):
        a, b = root(int(left[i])), root(int(right[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            edges.append((int(left[i]), int(right[j])))
    return edges


def _block_pair(key: tuple, table: pa.Table, percent: int) -> pa.Table:
    """Forest of the links between block ``i`` and block ``j`` of a bucket's members."""
    blocks = table.column("block").to_numpy()
    nodes = table.column("node").to_numpy()
    shingles = table.column("shingles").combine_chunks()
    offsets, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
    sets = [values[offsets[k]:offsets[k + 1]] for k in range(len(nodes))]
    i, j = key[1].as_py(), key[2].as_py()
    one, two = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    edges = []
    if len(one) and len(two):
        edges = forest(close([sets[k] for k in one], [sets[k] for k in two], percent), nodes[one], nodes[two])
    return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(two, "b").join(one, "a").withColumn("common", common)
            .where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common")))
            .select("a", "b"))


def _leftover(buckets: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets that the star left in more than one component."""
    labelled = (buckets.where("node <> hub").join(roots, "node", "left")
                .select("key", "node", F.coalesce("root", "node").alias("root")))
    mixed = (labelled.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("low"),
                                         F.max("root").alias("high"))
             .where("low < high").select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    dealt = (labelled.join(mixed, "key")
             .withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = (dealt.withColumn("other", other)
              .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      "block", "node"))
    return (paired.join(sets, "node").groupBy("key", "i", "j")
            .applyInArrow(lambda key, table: _block_pair(key, table, percent), "a long, b long"))


def _grouped(docs: DataFrame, at: Threshold) -> DataFrame:
    """``doc_id, row_key, n_shingles, root`` of every row; the root names its component, or is null."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("row_key", row_key())
    sketch = stored(keyed.mapInArrow(partial(_sketch, bands=at.bands, rows=at.rows), SKETCH), "sketch")
    nodes = sketch.where("n_shingles > 0").dropDuplicates(["node"])
    banded = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    hubs = (banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"))
            .where("hub < last").select("key", "hub"))
    buckets = stored(banded.join(hubs, "key"), "buckets")
    members = buckets.select("node").union(buckets.select("hub")).distinct()
    # one row for each node: a text is needed once, whatever its number of copies
    one_row = (sketch.join(members, "node", "left_semi").groupBy("node")
               .agg(F.min("row_key").alias("row_key")))
    sets = stored(keyed.join(one_row, "row_key").select("node", "text").dropDuplicates(["node"])
                  .mapInArrow(_sets, "node long, shingles array<long>"), "sets")
    size = buckets.select(F.col("node").alias("hub"), F.col("n_shingles").alias("n_hub")).distinct()
    pairs = (buckets.where("node <> hub").select("node", "hub", "n_shingles").distinct().join(size, "hub")
             .where(100 * F.least("n_shingles", "n_hub") >= at.percent * F.greatest("n_shingles", "n_hub"))
             .select(F.col("hub").alias("a"), F.col("node").alias("b")))
    links = stored(_confirmed(pairs, sets, at.percent), "links")
    roots = stored(components(links), "roots")
    more = stored(_leftover(buckets, roots, sets, at.percent), "more-links")
    roots = components(links.union(more))
    return sketch.join(roots, "node", "left").select(
        "doc_id", "row_key", "n_shingles", F.coalesce("root", "node").alias("root"))


def row_key() -> Column:
    """One number for id and text together."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def near_duplicates(docs: DataFrame, at: Threshold = AT_85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Documents with ``100 * intersection >= percent * union`` (85 unless told otherwise) of their shingle sets are linked, directly or
    over others; ``component_id`` is the least doc_id that can be reached. A null or wordless text has
    no shingles and is linked with nothing. A null doc_id stays null, is never the least of a component
    that has others, and is kept where all its component's ids are null. Repeated rows come out as
    often as they come in. Other columns are ignored.
    """
    named = _grouped(docs, at)
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return named.join(least, "root", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, at: Threshold = AT_85) -> DataFrame:
    """``docs`` with all its columns, one row of each component: that of the least id, null ids last.

    Texts without words are in no component and all stay.
    """
    named = stored(_grouped(docs, at), "components")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    first = named.where("root is not null").groupBy("root").agg(F.min(place).alias("first")).select("first.row_key")
    row, repeated = fresh(docs, "row", "repeated")
    stays = stored(named.join(first.union(named.where("root is null").select("row_key")).distinct(), "row_key", "left_semi")
                   .groupBy(F.col("row_key").alias(row)).agg(
                       (F.max(F.col("root").isNotNull()) & (F.count(F.lit(1)) > 1)).alias(repeated)), "stays")
    kept = docs.withColumn(row, row_key()).join(stays, row)
    whole = kept.where(~F.col(repeated))
    if not stays.where(repeated).isEmpty():  # rows that are equal in id and text
        whole = whole.unionByName(kept.where(repeated).dropDuplicates([row]))
    return whole.select(*docs.columns)
