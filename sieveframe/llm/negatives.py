"""Hard negatives by slots: the upper limits of an anchor's positives split all scores into disjoint slots.

First the positives: of the rows that share an anchor's label, those with the highest scores. A positive
takes as negatives the rows of other labels whose score lies in a window below its own. The windows of an
anchor overlap, but their upper limits cut the scores into disjoint slots, and a window is a run of whole
slots down to its lower limit. So each task keeps the top ``k`` of every slot, tasks' tops are combined to
the top ``k`` of the slot, and merging the slots from the lowest up answers all windows of the anchor.

Scores are integer products of blocks of anchors and blocks of rows, which meet in tasks; a label or a table
of any size is more blocks, never a larger one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveframe.llm.tables import stored

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # a negative's score, in hundredths of the positive's
SCALE = 256
ANCHORS, ROWS = 2048, 8192  # vectors of a block
TILE = 1 << 21  # scores that are held at a time
LEAST = np.iinfo(np.int64).min

FOUND = "anchor long, slot int, other long, id long, score long"
NEAR = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("other", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def share_floor(score: np.ndarray, percent: int) -> np.ndarray:
    """``floor(percent * score / 100)`` without products beyond 64 bits."""
    return score // 100 * percent + score % 100 * percent // 100


def share_ceil(score: np.ndarray, percent: int) -> np.ndarray:
    return score // 100 * percent - (-(score % 100) * percent) // 100


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` and ``b``, whole numbers held as doubles.

    Doubles are exact as long as no sum can pass 2**53; beyond that Python's integers are used, and a
    result that does not fit 64 bits is set to the end of their range.
    """
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.clip(whole, LEAST + 1, -(LEAST + 1)).astype(np.int64)


def tops(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest allowed scores of each row; of equal ones the first columns."""
    if scores.shape[1] > k:
        masked = np.where(allowed, scores, LEAST)
        allowed = allowed & (scores >= np.partition(masked, -k, axis=1)[:, -k][:, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("q").combine_chunks()
    return column.flatten().to_numpy().reshape(table.num_rows, -1)


def _ordered(rows: pa.Table) -> pa.Table:
    """By vec_id, null last: of equal scores the first come first."""
    return rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])


def _ids(table: pa.Table) -> np.ndarray:
    """Ids with a number for null that is no id's equal, as each null is a vector of its own."""
    ids = table.column("vec_id").combine_chunks()
    return np.where(ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), -1), \
        ids.is_valid().to_numpy(zero_copy_only=False)


def _positives(key: tuple, anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The top ``k`` of a block of rows for each anchor of a block, all of one label."""
    found = []
    if anchors.num_rows and rows.num_rows:
        rows = _ordered(rows)
        one, two = _matrix(anchors), _matrix(rows)
        known = rows.column("vec_id").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        id_a, id_r = anchors.column("vec_id").to_numpy(), pc.fill_null(rows.column("vec_id"), 0).to_numpy()
        step = max(1, TILE // len(two))
        for start in range(0, len(one), step):
            part = slice(start, start + step)
            scores = products(one[part], two)
            i, j = tops(scores, ~((id_a[part, None] == id_r[None, :]) & known[None, :]), k)
            found.append(_answers(anchors, rows, start + i, j, scores[i, j], np.zeros(len(i))))
    return pa.concat_tables(found) if found else NEAR.empty_table()


def _negatives(key: tuple, anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """The top ``k`` of a block of rows in every slot of each anchor of a block."""
    found = []
    if anchors.num_rows and rows.num_rows:
        rows = _ordered(rows)
        one, two = _matrix(anchors), _matrix(rows)
        label_a, label_r = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
        positives = anchors.column("scores").to_pylist()  # the highest first
        slots = max(map(len, positives))
        most = np.full((len(one), slots + 1), LEAST)
        least = np.full((len(one), slots), -LEAST - 1)
        for i, scores in enumerate(positives):
            most[i, :len(scores)] = share_floor(np.array(scores, np.int64), high)
            least[i, :len(scores)] = share_ceil(np.array(scores, np.int64), low)
        step = max(1, TILE // len(two))
        for start in range(0, len(one), step):
            part = slice(start, start + step)
            scores = products(one[part], two)
            differ = label_a[part, None] != label_r[None, :]
            for slot in range(slots):
                # Windows that reach into this slot belong to this positive or to higher ones, so none goes lower.
                inside = differ & (scores <= most[part, slot, None]) & (scores > most[part, slot + 1, None]) \
                    & (scores >= least[part, slot, None])
                i, j = tops(scores, inside, k)
                found.append(_answers(anchors, rows, start + i, j, scores[i, j], np.full(len(i), slot)))
    return pa.concat_tables(found) if found else NEAR.empty_table()


def _answers(anchors: pa.Table, rows: pa.Table, i: np.ndarray, j: np.ndarray, scores: np.ndarray, slot: np.ndarray) -> pa.Table:
    return pa.table([anchors.column("row").take(pa.array(i)), pa.array(slot.astype(np.int32)), rows.column("row").take(pa.array(j)),
                     rows.column("vec_id").take(pa.array(j)), pa.array(scores)], schema=NEAR)


def rows_of(vectors: DataFrame, anchor: Column, scale: int) -> DataFrame:
    """``row, vec_id, label, size, anchor, q`` of the rows that take part."""
    def whole(x: Column) -> Column:
        scaled = x * F.lit(float(scale))  # from 2**52 on a double has no fraction, and floor() would end at a long
        return F.when(F.abs(scaled) < 2.0 ** 52, F.floor(scaled).cast("double")).otherwise(scaled)

    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall(
        F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size("embedding").alias("size"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.transform(F.col("embedding").cast("array<double>"), whole).alias("q"))
    return stored(given.distinct().select(F.monotonically_increasing_id().alias("row"), "*"), "negatives-rows")


def _met(anchors: DataFrame, rows: DataFrame, cells: list[str], work) -> DataFrame:
    """``work`` on every block of anchors and every block of rows of a cell."""
    def number(side: DataFrame, name: str, block: int) -> DataFrame:
        return side.groupBy(cells).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    blocks = number(anchors, "n_a", ANCHORS).join(number(rows, "n_r", ROWS), cells)

    def dealt(side: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        block = F.pmod(F.xxhash64("row"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        found = side.join(blocks, cells).withColumn(names[0], block).withColumn(names[1], every).drop("n_a", "n_r")
        return found.select(*[F.col(c).alias(c) for c in found.columns])  # both sides come from one table

    keys = [*cells, "i", "j"]
    return dealt(anchors, "n_a", "n_r", ("i", "j")).groupBy(keys).cogroup(
        dealt(rows, "n_r", "n_a", ("j", "i")).groupBy(keys)).applyInArrow(work, FOUND)


def _first(found: DataFrame, within: list[str], k: int) -> DataFrame:
    """The ``k`` highest scores of each group, ties by smaller id; tasks cut their own before the shuffle."""
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("other")]
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vectors(vec_id, embedding, label)``.

    Anchors are the rows for which ``anchor`` holds, by default those whose vec_id is divisible by 100. A
    row's score is the integer product of its components, each ``floor(scale * x)``, with the anchor's. The
    positives of an anchor are its ``positives`` highest other rows of the same label, and for each the
    ``negatives`` highest rows of other labels with ``low * positive <= 100 * negative <= high * positive``
    come back, ranked from 1; ties go to the smaller vec_id, null last.

    Rows with a null label, a null or empty vector, or a null or non-finite component take no part, nor do
    vectors of another length than the anchor's. Repeated rows count once; rows that share a vec_id only are
    not each other's positives. A null vec_id is no anchor. Other columns are ignored.
    """
    rows = rows_of(vectors, (F.col("vec_id") % 100 == 0) if anchor is None else anchor, scale)
    anchors = rows.where(F.col("anchor") & F.col("vec_id").isNotNull())
    plain = ["row", "vec_id", "label", "size", "q"]
    rows = rows.select("anchor", *plain)
    near = _met(anchors.select(*plain), rows.select(*plain), ["label", "size"], lambda key, a, r: _positives(key, a, r, positives))
    best = stored(_first(near, ["anchor"], positives), "negatives-positives")
    listed = best.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    slotted = _met(anchors.select(*plain).join(listed, "row"), rows.select(*plain), ["size"],
                   lambda key, a, r: _negatives(key, a, r, negatives, low, high))
    kept = _first(slotted, ["anchor", "slot"], negatives)
    entry = F.struct("slot", "place", "id", "score")
    lists = kept.groupBy("anchor").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    merged, suffixes = F.array().cast("array<struct<slot:int,place:int,id:long,score:long>>"), []
    for slot in reversed(range(positives)):  # a higher slot holds higher scores, so it goes before what is merged
        own = F.filter("all", lambda x: x["slot"] == F.lit(slot))  # noqa: B023 (called at once)
        merged = F.slice(F.concat(own, merged), 1, negatives)
        suffixes.insert(0, merged)
    answers = lists.select("anchor", F.array(*suffixes).alias("suffixes"))
    lowest = F.expr(f"score div 100 * {low} + ceil(score % 100 * {low} / 100)")
    taken = best.select("anchor", "place", F.col("id").alias("positive_id"), "score", lowest.alias("lowest")).join(answers, "anchor") \
        .withColumn("window", F.filter(F.element_at("suffixes", F.col("place")), lambda x: x["score"] >= F.col("lowest"))) \
        .select("anchor", "positive_id", "score", F.posexplode("window"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return taken.join(names, "anchor").select(
        "anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("negative_id"),
        F.col("score").alias("positive_score"), F.col("col.score").alias("negative_score"))
