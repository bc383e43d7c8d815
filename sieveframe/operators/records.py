"""Control records: messages, jobs, deliveries. Each operator is a DataFrame plan over event rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveframe.functions.cells import column
from sieveframe.operators.joins import is_small, spread_join, values_frame

# Fixed values.
ACTIVE = ["queued", "running"]
FINISHED = ["done", "failed"]
PENDING_LIMIT = 25
RETENTION_DAYS = 7


def _by_extreme(df: DataFrame, keys: Sequence[str], extreme, order: str) -> DataFrame:
    """One row per key, folded inside each task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[column(c) for c in rest])
    best = df.groupBy(*[column(k) for k in keys]).agg(extreme(row, column(order)).alias("_row"))
    return best.select(*[column(k) if k in keys else F.col("_row")[k].alias(k) for k in df.columns])


def latest_by_key(df: DataFrame, key: str | Sequence[str], order: str, where: Column | None = None) -> DataFrame:
    """The record with the highest ``order`` of each key, among those that satisfy ``where``.

    ``order`` is unique within a key, as message and job numbers are.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return _by_extreme(df if where is None else df.filter(where), keys, F.max_by, order)


def first_by_key(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """The record with the lowest ``order`` of each key: the first arrival wins."""
    keys = [key] if isinstance(key, str) else list(key)
    return _by_extreme(df, keys, F.min_by, order)


def oldest(df: DataFrame, order: str, n: int = 1, where: Column | None = None) -> DataFrame:
    """The ``n`` records of lowest ``order``, a top-k that each task cuts before the merge."""
    return (df if where is None else df.filter(where)).orderBy(column(order)).limit(n)


def pending(df: DataFrame, order: str, payload: str, n: int = PENDING_LIMIT) -> DataFrame:
    """The first records whose payload is still there, that is, not yet handled."""
    return oldest(df, order, n, column(payload).isNotNull())


def status_fold(df: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """Last status of each job; one that was running when the service stopped is queued again."""
    last = df.groupBy(column(key)).agg(F.max_by(column(status), column(order)).alias("last"),
                                       F.max(column(order)).alias(order))
    return last.select(column(key), column(order), F.when(F.col("last") == "running", "queued").otherwise(
        F.col("last")).alias(status))


def active_counts(df: DataFrame, key: str, status: str, active: Sequence[str] = ACTIVE) -> DataFrame:
    """Active records per key, and in total in the row whose key is NULL."""
    per_key = df.groupBy(column(key)).agg(F.count_if(column(status).isin(*active)).alias("active"))
    return per_key.rollup(column(key)).agg(F.sum("active").alias("active"))


def in_status(df: DataFrame, status: str, wanted: Sequence[str]) -> DataFrame:
    return df.filter(column(status).isin(*wanted))


def expired(created: str, now: Column, days: int = RETENTION_DAYS) -> Column:
    """True for records older than the retention period."""
    return column(created) < now - F.make_dt_interval(F.lit(days))


def retain(records: DataFrame, created: str, finished: Column, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Records without the old finished ones; what is still active stays however old it is."""
    return records.filter(~(expired(created, now, days) & F.coalesce(finished, F.lit(False))))


def retain_children(children: DataFrame, records: DataFrame, key: str, created: str, finished: Column,
                    now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows such as deliveries without those of the records that ``retain`` drops."""
    dropped = records.filter(expired(created, now, days) & F.coalesce(finished, F.lit(False)))
    return spread_join(children, dropped.select(column(key)).distinct(), [key], "left_anti")


def delivery_gaps(expected: DataFrame, delivered: DataFrame, keys: Sequence[str] = ("job", "name")) -> DataFrame:
    """Expected deliveries that are not recorded, each once.

    A set difference by one aggregation over both sides: a pair that is repeated very often is folded
    inside the tasks, where a join would send all its copies to one.
    """
    def side(df: DataFrame, expect: bool) -> DataFrame:
        return df.select(*[column(k) for k in keys], F.lit(expect).alias("_expected"))

    seen = side(expected, True).unionByName(side(delivered, False)).groupBy(*[column(k) for k in keys])
    return seen.agg(F.bool_and("_expected").alias("_open")).filter("_open").drop("_open")


def allow_list(df: DataFrame, user: str, ids: Sequence | DataFrame) -> DataFrame:
    """Rows of the listed users; an empty list admits everyone.

    A list from the caller is broadcast only while it is short; a longer one, or a DataFrame of
    ids, whose size is not known, is joined with the users' rows spread over the tasks.
    """
    if isinstance(ids, DataFrame):
        known = ids.select(ids.columns[0]).distinct().toDF(user)
        return spread_join(df, known, [user], "left_semi")
    if not ids:
        return df
    listed = values_frame(df, user, ids)
    return df.join(F.broadcast(listed), user, "left_semi") if is_small(ids) else spread_join(
        df, listed, [user], "left_semi")
