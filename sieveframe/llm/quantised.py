"""Near-duplicate vectors by product quantisation: inverted lists, table-lookup distances, exact rerank.

Unit vectors go to the list of their nearest coarse centroid; the residual is cut into subspaces, each
coded by its nearest codeword. A vector is compared with every list that can hold a link of it. All that is
in a list is nearer to its centroid than to any other, so a vector further than the limit beyond the plane
halfway between that centroid and one of its own ``PROBES`` nearest has no link there. Its distance to a
coded vector is a sum of table entries, and as every code knows its error ``e``, only vectors with
``distance <= limit + e`` can be links. These are compared by cosine on the vectors themselves, so that
neither lists nor codes lose a link. The centroids are fitted on a bounded sample; every row is in the index.

Equal vectors are one node. Neighbouring lists form groups, which are met in blocks inside tasks; of two
vectors in different lists only one asks. Tasks emit a number of links for each vector and a spanning
forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveframe.llm.graph import components
from sieveframe.llm.tables import stored

SAMPLE_ROWS = 20_000  # vectors that the centroids are fitted on
PER_CELL, MAX_CELLS = 512, 4096
PROBES = 12  # nearest centroids whose planes tell which lists cannot hold a link
GROUP = 8  # lists that are met together, on average
SUBSPACES, CODEWORDS = 8, 64
BLOCK = 4096  # coded vectors, and queries, of a group that meet in one task
PAIRS = 1 << 17  # candidates that are reranked at a time
TABLE = 1 << 20  # distances that are looked up at a time
SLACK = 1e-9  # on squared distances, for rounding
COSINE = 0.93

NODES = "vec_id long, node long, label long, size int, vector array<float>"
CODED = "node long, copies long, label long, size int, home int, grp int, groups array<int>, codes array<int>, error double, vector array<float>"


@dataclass
class Index:
    """Coarse centroids, and codewords of each part of the residual, for vectors of one length."""

    centroids: np.ndarray
    cuts: np.ndarray
    codewords: list[np.ndarray]
    groups: np.ndarray | None = None  # the group of each list; one for all if not given

    def reach(self, units: np.ndarray, pivots: np.ndarray, cells: np.ndarray, limit: float) -> np.ndarray:
        """Which of the lists may hold a vector within ``limit`` of each unit; ``pivots`` are centroids near it."""
        there = self.centroids[cells]
        far = squared(units, there)
        near = np.ones(far.shape, bool)
        for k in range(pivots.shape[1]):
            pivot = self.centroids[pivots[:, k]]
            apart = np.sqrt(np.maximum(squared(pivot, there), 0))
            near &= far - ((units - pivot) ** 2).sum(1)[:, None] <= 2 * limit * apart + SLACK
        return near

    def nearest(self, units: np.ndarray, n: int) -> np.ndarray:
        """The numbers of the ``n`` nearest centroids, the nearest first."""
        distance = (self.centroids ** 2).sum(1) - 2 * units @ self.centroids.T
        return np.argsort(distance, axis=1, kind="stable")[:, :n]

    def code(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each part, and the length of what they leave."""
        codes, left = [], np.zeros(len(residuals))
        for low, high, words in zip(self.cuts, self.cuts[1:], self.codewords):
            distance = squared(residuals[:, low:high], words)
            codes.append(distance.argmin(1))
            left += np.maximum(distance.min(1), 0)
        return np.stack(codes, 1), np.sqrt(left)

    def distances(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distance of every query to every coded vector of the cell, by table look-up."""
        total = np.zeros((len(query), len(codes)))
        residuals = query - self.centroids[cell]
        for k, (low, high, words) in enumerate(zip(self.cuts, self.cuts[1:], self.codewords)):
            total += squared(residuals[:, low:high], words)[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2 * a @ b.T


def centres(points: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Plain k-means from seeded rows; a centre without points stays."""
    rng = np.random.default_rng(seed)
    found = points[rng.choice(len(points), min(n, len(points)), replace=False)].copy()
    for _ in range(rounds):
        owner = squared(points, found).argmin(1)
        count = np.bincount(owner, minlength=len(found))
        sums = np.stack([np.bincount(owner, points[:, k], len(found)) for k in range(points.shape[1])], 1)
        found[count > 0] = sums[count > 0] / count[count > 0, None]
    return found


def fit(units: np.ndarray, cells: int, seed: int = 6) -> Index:
    index = Index(centres(units, cells, seed), np.linspace(0, units.shape[1], min(SUBSPACES, units.shape[1]) + 1).astype(int), [])
    residuals = units - index.centroids[index.nearest(units, 1)[:, 0]]
    for k, (low, high) in enumerate(zip(index.cuts, index.cuts[1:])):
        index.codewords.append(centres(residuals[:, low:high], CODEWORDS, seed + 1 + k))
    middles = centres(index.centroids, -(-len(index.centroids) // GROUP), seed)
    index.groups = squared(index.centroids, middles).argmin(1)
    return index


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("embedding").to_pylist()
        labels = batch.column("label").to_pylist()
        nodes, sizes, kept = [], [], []
        for vector, label in zip(vectors, labels):
            usable = label is not None and vector and None not in vector
            values = np.array(vector if usable else [], np.float32)
            usable = usable and np.isfinite(values).all() and bool(values.any())
            seed = xxhash.xxh3_64_intdigest(str(label).encode()) if usable else 0
            nodes.append(xxhash.xxh3_64_intdigest(values.tobytes(), seed=seed) - (1 << 63) if usable else None)
            sizes.append(len(values) if usable else None)
            kept.append(vector if usable else None)
        yield pa.RecordBatch.from_arrays([
            batch.column("vec_id"), pa.array(nodes, pa.int64()), batch.column("label"), pa.array(sizes, pa.int32()),
            pa.array(kept, pa.list_(pa.float32()))], ["vec_id", "node", "label", "size", "vector"])


def _matrix(column: pa.ListArray | pa.ChunkedArray, width: int, dtype: type = np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), width)


def _limit(cosine: float) -> float:
    """The distance of unit vectors at that cosine, with room for rounding."""
    return np.sqrt(2 - 2 * cosine) + 1e-6


def _coded(batches: Iterator[pa.RecordBatch], indices: dict[int, Index], probes: int, cosine: float
           ) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            index = indices.get(int(size)) or trivial(int(size))
            units = unit_rows(_matrix(part.column("vector"), size))
            near = index.nearest(units, max(probes, 1))
            home = near[:, 0]
            codes, error = index.code(units - index.centroids[home])
            every = np.arange(len(index.centroids))
            # a list before its own asks in turn
            asked = index.reach(units, near, every, _limit(cosine)) & (every >= home[:, None])
            groups = np.zeros(len(every), int) if index.groups is None else index.groups
            rows, cells = np.nonzero(asked)
            pairs = np.unique(rows * (groups.max() + 1) + groups[cells])
            ends = np.searchsorted(pairs, np.arange(part.num_rows + 1) * (groups.max() + 1))

            def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32).ravel()))

            yield pa.RecordBatch.from_arrays([
                part.column("node"), part.column("copies"), part.column("label"), part.column("size"),
                pa.array(home.astype(np.int32)), pa.array(groups[home].astype(np.int32)),
                lists(pairs % (groups.max() + 1), ends),
                lists(codes, np.arange(part.num_rows + 1) * codes.shape[1]), pa.array(error), part.column("vector")],
                ["node", "copies", "label", "size", "home", "grp", "groups", "codes", "error", "vector"])


def trivial(size: int) -> Index:
    """For lengths that the sample does not hold: one list, and codes that say nothing."""
    return Index(np.zeros((1, size)), np.array([0, size]), [np.zeros((1, size))])


def _roots(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Least member of each component of ``n`` numbers under the links ``one[k], two[k]``."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, one, root[two])
        np.minimum.at(new, two, root[one])
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _compare(key: tuple, table: pa.Table, indices: dict[int, Index], cosine: float) -> pa.Table:
    """Links between a block of queries and a block of a group's members: counts, and a forest."""
    size = key[1].as_py()
    index = indices.get(size) or trivial(size)
    query = table.column("query").to_numpy(zero_copy_only=False).astype(bool)
    units = unit_rows(_matrix(table.column("vector"), size))
    node, copies, home = (table.column(c).to_numpy() for c in ("node", "copies", "home"))
    codes = _matrix(table.column("codes"), len(index.codewords), np.int64)
    error = table.column("error").to_numpy()
    asks, holds = np.flatnonzero(query), np.flatnonzero(~query)
    limit = _limit(cosine)
    first = {int(x): k for k, x in reversed(list(enumerate(node)))}  # a vector may be both query and member
    place = np.array([first[int(x)] for x in node])
    count, ones, twos = np.zeros(len(node)), [], []
    for cell in np.unique(home[holds]):
        members = holds[home[holds] == cell]
        asking = asks[home[asks] <= cell]
        asking = asking[index.reach(units[asking], home[asking][:, None], np.array([cell]), limit)[:, 0]]
        step = max(1, TABLE // len(members))
        for low in range(0, len(asking), step):
            one, two = _links(index, cell, asking[low:low + step], members, units, codes, error, node, limit, cosine)
            count += np.bincount(one, copies[two], len(node))
            across = home[one] != cell  # in one list, both ask
            count += np.bincount(two[across], copies[one[across]], len(node))
            names, at = np.unique(place[np.concatenate([one, two])], return_inverse=True)
            root = _roots(len(names), at[:len(one)], at[len(one):])
            ones.append(names)
            twos.append(names[root])
    has = np.flatnonzero(count)
    none = np.zeros(0, np.int64)
    root = _roots(len(node), np.concatenate([none, *ones]), np.concatenate([none, *twos]))
    edge = np.flatnonzero(root != np.arange(len(node)))
    return pa.table({"node": pa.array(np.concatenate([node[has], node[edge]])),
                     "links": pa.array(np.concatenate([count[has].astype(np.int64), np.zeros(len(edge), np.int64)])),
                     "other": pa.array(np.concatenate([node[has], node[root[edge]]]))})


def _links(index: Index, cell: int, asking: np.ndarray, members: np.ndarray, units: np.ndarray, codes: np.ndarray,
           error: np.ndarray, node: np.ndarray, limit: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of ``asking`` and ``members`` of a list."""
    near = index.distances(units[asking], cell, codes[members]) <= limit + error[members]
    near &= node[asking][:, None] != node[members][None, :]
    if 8 * np.count_nonzero(near) > near.size:  # one product for all is quicker than one for each candidate
        near &= units[asking] @ units[members].T >= cosine
        i, j = np.nonzero(near)
        return asking[i], members[j]
    i, j = np.nonzero(near)
    one, two = asking[i], members[j]
    keep = [np.einsum("ij,ij->i", units[one[k:k + PAIRS]], units[two[k:k + PAIRS]]) >= cosine for k in range(0, len(i), PAIRS)]
    keep = np.concatenate([np.zeros(0, bool), *keep])
    return one[keep], two[keep]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label)``.

    Rows are linked if their labels are equal and not null and their cosine, in double precision, is at
    least ``cosine``. A vector that is null, empty or zero, or holds a null or non-finite component, is
    linked with nothing; vectors of different lengths are not linked. A null vec_id stays null and is never
    the least of a component that has others. Repeated rows are linked with each other like equal
    vectors. No link is left out, whatever ``probes`` is; more of them cut more comparisons. Other columns
    are ignored.
    """
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"), F.col("label").cast("long"))
    rows = stored(given.mapInArrow(_nodes, NODES), "vectors")
    usable = rows.where("node is not null")
    counts = usable.groupBy("node").agg(F.count(F.lit(1)).alias("copies"))
    nodes = usable.dropDuplicates(["node"]).drop("vec_id").join(counts, "node")
    total = counts.count()
    sample = usable.orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS).select("size", "vector").toArrow()
    indices = {}
    for size in set(sample.column("size").to_pylist()):
        part = sample.filter(pa.array(sample.column("size").to_numpy() == size))
        units = np.unique(unit_rows(_matrix(part.column("vector"), size)), axis=0)
        indices[size] = fit(units, min(MAX_CELLS, max(1, total // PER_CELL)))
    coded = stored(nodes.mapInArrow(partial(_coded, indices=indices, probes=probes, cosine=cosine), CODED), "coded")
    plain = coded.drop("groups")
    members = plain.withColumn("query", F.lit(False))
    asking = coded.withColumn("grp", F.explode("groups")).select(*plain.columns).withColumn("query", F.lit(True))
    cells = ["label", "size", "grp"]
    blocks = (members.groupBy(cells).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_members"))
              .join(asking.groupBy(cells).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_asking")), cells))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        block = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        names = ("i", "j") if own == "n_members" else ("j", "i")
        return side.join(blocks, cells).withColumn(names[0], block).withColumn(names[1], every)

    met = dealt(members, "n_members", "n_asking").unionByName(dealt(asking, "n_asking", "n_members"))
    found = stored(met.groupBy(*cells, "i", "j").applyInArrow(
        lambda key, table: _compare(key, table, indices, cosine), "node long, links long, other long"), "vector-links")
    roots = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = rows.select("vec_id", "node").join(counts, "node", "left").join(links, "node", "left") \
        .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return named.join(least, "root", "left").select(
        "vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
