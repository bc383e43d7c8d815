"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveframe.functions.cells import column

SALTS = 16  # for streams, whose keys cannot be counted first
SALT = "_salt"
BROADCAST_ROWS = 100_000
TRACKED = 1 << 16  # keys that the sketch holds; any key above 1 / LEAST_SHARE of the rows is among them
LEAST_SHARE = 10_000
LISTED = 2 * LEAST_SHARE


def heavy_keys(df: DataFrame, keys: Sequence[str], parts: int) -> list[tuple[int, int]]:
    """``(hash, pieces)`` of the keys with more rows than one of ``parts`` equal tasks would get.

    Found by a sketch of frequent items over the hash of the key, which is folded inside the tasks and never
    grows beyond ``TRACKED`` entries; only keys above ``1 / LEAST_SHARE`` of the rows are told. Keys that share a
    hash are cut alike, which changes no result.
    """
    listed = F.call_function("approx_top_k", F.col("h"), F.lit(LISTED), F.lit(TRACKED)).alias("top")
    found = df.select(F.xxhash64(*[column(k) for k in keys]).alias("h")).agg(F.count(F.lit(1)).alias("rows"), listed).first()
    least = max(found["rows"] / min(parts, LEAST_SHARE), 1)
    return [(item["item"], math.ceil(item["count"] / least)) for item in found["top"] or () if item["count"] > least]


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int | None = None,
                parts: int | None = None) -> DataFrame:
    """Join on ``keys``; keys that hold too much of ``left`` for one task are cut into pieces.

    The keys of ``left`` are counted first, by a sketch. Those with more rows than one of ``parts`` tasks (by
    default the number of shuffle partitions) would get are dealt over as many pieces as their share asks for,
    and only their rows of ``right`` are repeated; all other rows travel as in the plain join. ``right`` holds
    one row per key, so the result is that of the plain join. The piece is taken from the row's values, so a
    task that is run again deals the same rows alike. ``salts`` cuts every key into that many without counting;
    streams are always cut so.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("a spread join keeps the left side: inner, left, left_semi or left_anti")
    whole = F.xxhash64(*[column(c) for c in left.columns])
    if salts is not None or left.isStreaming:
        pieces = None
        mine, theirs = F.lit(salts or SALTS), F.lit(salts or SALTS)
    else:
        heavy = heavy_keys(left, keys, parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        if not heavy:
            return left.join(right, list(keys), how)
        pieces = left.sparkSession.createDataFrame(heavy, "_hash long, _pieces long")  # one row for each heavy key
        mine = theirs = F.coalesce(F.col("_pieces"), F.lit(1))

    def dealt(side: DataFrame) -> DataFrame:
        if pieces is None:
            return side
        return side.join(F.broadcast(pieces), F.xxhash64(*[column(k) for k in keys]) == F.col("_hash"), "left")

    salted_left = dealt(left).withColumn(SALT, F.pmod(whole, mine)).drop("_hash", "_pieces")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), theirs.cast("bigint") - 1))
    salted_right = dealt(right).withColumn(SALT, copies).drop("_hash", "_pieces")
    return salted_left.join(salted_right, [*keys, SALT], how).drop(SALT)


def values_frame(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """A caller's list as a one-column DataFrame of the type that ``name`` has in ``df``."""
    dtype = df.schema[name].dataType.simpleString()
    return df.sparkSession.createDataFrame([(v,) for v in set(values)], f"`{name}` {dtype}")


def is_small(values: Sequence) -> bool:
    return len(values) <= BROADCAST_ROWS


