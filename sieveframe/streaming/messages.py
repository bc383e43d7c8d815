"""Messages stored once, whenever they arrive, and forgotten only after they have been handled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sieveframe.functions.cells import column

KEPT_MS = 7 * 24 * 3600 * 1000  # how long a handled message is remembered
HORIZON = "7 days"  # an arrival this far behind the latest one is late

BUCKETS = 1 << 14  # of keys; fixed for the life of a checkpoint
_UNTIMED = 2**63 - 1  # in the place of a time that is missing, so that no column of numbers holds a null

_STATE = "keys array<string>, first array<long>, forget_at array<long>"  # of the messages of one bucket


def _ledger(keep_ms: int):
    def step(bucket: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        known = {key: (first, forget_at) for key, first, forget_at in zip(*state.get)} if state.exists else {}
        heard: dict[str | None, tuple[int, int, bool]] = {}  # earliest arrival, arrivals, whether handled
        if not state.hasTimedOut:
            for part in rows:
                for key, ts, handled in zip(part["key"].tolist(), part["ts"].tolist(), part["handled"].tolist()):
                    first, times, done = heard.get(key, (_UNTIMED, 0, False))
                    heard[key] = (first, times, True) if handled else (min(first, ts), times + 1, done)
        known = {key: entry for key, entry in known.items() if key in heard or not 0 < entry[1] < now}
        watermark = state.getCurrentWatermarkMs() * 1000 if heard else 0
        told = []
        for key, (earliest, times, handled) in heard.items():
            stored = key not in known and times > 0
            if not stored and key not in known:  # handled, but not known (any more)
                continue
            first, forget_at = (earliest, 0) if stored else known[key]
            known[key] = (first, now + keep_ms if handled else forget_at)
            told.append((key, first, stored, stored and first < watermark, times - stored))
        if known:
            firsts, due = zip(*known.values())
            state.update((list(known), list(firsts), list(due)))
            if any(due):  # a timer holds until the next call only
                state.setTimeoutDuration(max(min(filter(None, due)) - now, 1))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=["key", "first", "stored", "late", "replays"])

    return step


def _as_text(key: Column, kind: str) -> tuple[Column, Callable[[Column], Column]]:
    """A key as text that equal keys share, and the way back."""
    if kind == "binary":
        return F.base64(key), F.unbase64
    if kind == "timestamp":  # its text would depend on the zone
        return F.unix_micros(key).cast("string"), lambda text: F.timestamp_micros(text.cast("bigint"))
    if kind in ("float", "double"):  # one text for both zeros
        return (key + F.lit(0).cast(kind)).cast("string"), lambda text: text.cast(kind)
    if kind.startswith(("struct", "array")):
        options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
        return F.to_json(F.struct(key.alias("key")), options), lambda text: F.from_json(text, f"key {kind}", options)["key"]
    return key.cast("string"), lambda text: text.cast(kind)


def stream_ledger(stream: DataFrame, key: str, ts: str, handled: str | None = None, keep_ms: int = KEPT_MS,
                  horizon: str = HORIZON, buckets: int = BUCKETS) -> DataFrame:
    """``<key>, <ts>, stored, late, replays`` of each message in each micro-batch it is heard of; append mode.

    The first arrival of a key is stored, however late it comes; ``late`` says that it lay behind the
    watermark, so that late ones can be counted. Further arrivals are ``replays``. A message stays known until
    ``keep_ms`` after a row with ``handled`` has named it, and one that was never handled for good; the timer of
    its bucket forgets it, in the next micro-batch after it is due (run with ``idle=False``). The state is kept by
    bucket of keys, so that a micro-batch calls Python at most ``buckets`` times, however many keys it names, and
    writes the buckets it touches anew. Repeated arrivals meet in the task of their bucket; of each only the time is read.
    """
    done = F.coalesce(column(handled).cast("boolean"), F.lit(False)) if handled else F.lit(False)
    timed = stream.withColumn("_ledger_ts", column(ts).cast("timestamp")).withWatermark("_ledger_ts", horizon)
    text, back = _as_text(column(key), dict(stream.dtypes)[key])
    # The time itself goes along for its mark: without it in the rows, the watermark cannot be asked for.
    rows = timed.select("_ledger_ts", text.alias("key"), F.coalesce(F.unix_micros("_ledger_ts"), F.lit(_UNTIMED)).alias("ts"), done.alias("handled")) \
        .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    found = rows.groupBy("bucket").applyInPandasWithState(
        _ledger(keep_ms), "key string, first long, stored boolean, late boolean, replays long", _STATE, "append",
        GroupStateTimeout.ProcessingTimeTimeout)
    first = F.when(F.col("first") != _UNTIMED, F.timestamp_micros("first"))
    return found.select(back(F.col("key")).alias(key), first.alias(ts), "stored", "late", "replays")


def fold_ledger(written: DataFrame, key: str, ts: str) -> DataFrame:
    """One row for each message of a written ledger: when it was first heard of, whether late, and its replays."""
    return written.groupBy(column(key)).agg(
        F.min(column(ts)).alias(ts), F.bool_or(F.col("late")).alias("late"), F.sum("replays").alias("replays"))
