"""The same row rules and record folds over Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveframe.functions.cells import column
from sieveframe.plans.clean import OPERATIONS, resolve, row_steps
from sieveframe.functions import cells as C
from sieveframe.operators.rows import row_is_blank
from sieveframe.sources.tables import SourceTable, as_table


def stream_clean(stream: SourceTable | DataFrame, operation: str = "tidy", *, column: str | None = None,
                 direction: str | None = None) -> DataFrame:
    """The row-local part of a cleaning operation on a stream: no state, no shuffle.

    Columns keep their names unless the operation renames them; as a sink takes no name twice, a name
    that repeats another gets its unique form.
    """
    op = OPERATIONS[resolve(operation)]
    if op.dedup or not op.writes:
        raise ValueError("only operations that look at one row at a time apply to a stream")
    table = as_table(stream)
    steps = row_steps(table, op, column, direction)
    if op.drop_empty:
        steps = steps.filter(~row_is_blank(table.names))
    cells = [C.guard(C.column(n)).alias(n) if op.guard else C.column(n) for n in table.names]
    if op.rename:
        return steps.select(*cells)
    given = [*table.originals, *table.extra_names]
    lower = [name.lower() for name in given]
    kept = [name if lower.count(name.lower()) == 1 and name else unique for name, unique in zip(given, table.names)]
    return steps.select(*cells).toDF(*kept)


def stream_dedup(stream: DataFrame, key: str | Sequence[str], ts: str | None = None,
                 horizon: str | None = None) -> DataFrame:
    """Each key once, its first arrival; replays are ignored.

    With ``ts`` and ``horizon`` the state is bounded by the watermark and a replay is recognised
    within the horizon; a first arrival later than the watermark is dropped. Without them no message
    is ever lost, and the keys seen stay in the state store.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if ts is None or horizon is None:
        return stream.dropDuplicates(keys)
    timed = stream.withColumn(ts, column(ts).cast("timestamp"))
    return timed.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


def stream_latest(stream: DataFrame, key: str, order: str, values: Sequence[str]) -> DataFrame:
    """Last value per key, by ``order``; use update or complete output mode."""
    row = F.struct(column(order), *[column(v) for v in values])
    last = stream.groupBy(column(key)).agg(F.max_by(row, column(order)).alias("_row"))
    return last.select(column(key), *[F.col("_row")[name].alias(name) for name in (order, *values)])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", idle: bool = True) -> DataFrame:
    """Process all that has arrived into a Parquet table and read the table back.

    The file sink commits a batch once, so a restart from ``checkpoint`` repeats nothing. Without ``idle``
    batches are run for new data only: timers by the clock would ask for another one for ever.
    """
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = stream.sparkSession.conf.get(setting)
    stream.sparkSession.conf.set(setting, str(idle).lower())
    try:
        return _run_available(stream, path, checkpoint, mode)
    finally:
        stream.sparkSession.conf.set(setting, before)


def _run_available(stream: DataFrame, path: str, checkpoint: str, mode: str) -> DataFrame:
    query = (stream.writeStream.format("parquet").outputMode(mode)
             .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Store every batch under its own number before the offset advances.

    A batch that is repeated after a failure replaces its own folder: at least once becomes once.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream.writeStream.outputMode(mode).foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def fold_batches(df: DataFrame, key: str, order: str = "batch") -> DataFrame:
    """Latest row per key of a table written by ``ingest`` from an updating stream."""
    from sieveframe.operators.records import latest_by_key

    return latest_by_key(df, key, order).drop(order)
