"""Queries for control records and streams, on the provided events, orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveframe.catalog import sqltext as Q
from sieveframe.catalog.base import load, query
from sieveframe.functions import cells as C
from sieveframe.operators import records as R
from sieveframe.session import scratch_folder
from sieveframe.streaming.messages import fold_ledger, stream_ledger
from sieveframe.streaming.records import fold_batches, ingest, run_available, stream_clean, stream_dedup as dedup_stream, stream_latest
from sieveframe.streaming.snapshots import compact, read_latest, store_batch

_STATUS_SQL = ("case event_type when 'signup' then 'queued' when 'view' then 'running' when 'error' then 'failed' "
               "else 'done' end")
_JOBS_SQL = (f"j as (select event_id, user_id, ts, {_STATUS_SQL} as status, "
             "case when event_type = 'purchase' then props end as report from events)")
_NOW_SQL = "timestamp '2024-01-25 12:00:00'"
_OLD_SQL = f"(ts < {_NOW_SQL} - interval 7 day and status in ('done', 'failed'))"


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    status = (F.when(kind == "signup", "queued").when(kind == "view", "running").when(kind == "error", "failed")
              .otherwise("done"))
    return load(spark, folder, "events").select(
        "event_id", "user_id", "ts", status.alias("status"), F.when(kind == "purchase", F.col("props")).alias("report"))


@query(f"with {_JOBS_SQL} select event_id, user_id, status, report from j "
       "qualify row_number() over (partition by user_id order by event_id desc) = 1")
def latest_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return R.latest_by_key(_jobs(spark, folder).drop("ts"), "user_id", "event_id")


@query(f"with {_JOBS_SQL} select event_id, user_id, status, report from j where report is not null "
       "qualify row_number() over (partition by user_id order by event_id desc) = 1")
def latest_with_report(spark: SparkSession, folder: str) -> DataFrame:
    return R.latest_by_key(_jobs(spark, folder).drop("ts"), "user_id", "event_id", F.col("report").isNotNull())


@query(f"with {_JOBS_SQL} select event_id, user_id, status, report from j "
       "qualify row_number() over (partition by user_id order by event_id) = 1")
def first_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return R.first_by_key(_jobs(spark, folder).drop("ts"), "user_id", "event_id")


@query(f"with {_JOBS_SQL} select event_id, user_id, status from j where status = 'queued' order by event_id limit 1")
def oldest_queued(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder).select("event_id", "user_id", "status")
    return R.oldest(jobs, "event_id", 1, F.col("status") == "queued")


@query(f"with {_JOBS_SQL} select event_id, user_id, report from j where report is not null order by event_id limit 25")
def oldest_k(spark: SparkSession, folder: str) -> DataFrame:
    return R.pending(_jobs(spark, folder).select("event_id", "user_id", "report"), "event_id", "report")


@query(f"with {_JOBS_SQL} select event_id, user_id, status from j where status in ('queued', 'running')")
def active_records(spark: SparkSession, folder: str) -> DataFrame:
    return R.in_status(_jobs(spark, folder).select("event_id", "user_id", "status"), "status", R.ACTIVE)


@query(f"with {_JOBS_SQL} select user_id, max(event_id) as event_id, "
       "case arg_max(status, event_id) when 'running' then 'queued' else arg_max(status, event_id) end as status "
       "from j group by user_id")
def status_fold(spark: SparkSession, folder: str) -> DataFrame:
    return R.status_fold(_jobs(spark, folder), "user_id", "status", "event_id")


@query(f"with {_JOBS_SQL} select user_id, cast(count(*) filter (status in ('queued', 'running')) as bigint) as active "
       "from j group by rollup (user_id)")
def active_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.active_counts(_jobs(spark, folder), "user_id", "status")


def _finished():
    return F.col("status").isin(*R.FINISHED)


def _now():
    return F.to_timestamp_ntz(F.lit("2024-01-25 12:00:00"))


@query(f"with {_JOBS_SQL} select event_id, user_id, status from j where not {_OLD_SQL}")
def retention(spark: SparkSession, folder: str) -> DataFrame:
    return R.retain(_jobs(spark, folder), "ts", _finished(), _now()).select("event_id", "user_id", "status")


@query(f"with {_JOBS_SQL}, d as (select event_id, unnest(['part-1', 'part-2', 'report']) as name from events) "
       f"select d.event_id, name from d anti join (select * from j where {_OLD_SQL}) o using (event_id)")
def retained_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    names = F.explode(F.array(*map(F.lit, ("part-1", "part-2", "report"))))
    deliveries = load(spark, folder, "events").select("event_id", names.alias("name"))
    return R.retain_children(deliveries, _jobs(spark, folder), "event_id", "ts", _finished(), _now())


@query("""with e as (select l_orderkey as job, 'part-' || l_linenumber as name from lineitem
                 union select o_orderkey, 'report' from orders),
    d as (select l_orderkey as job, 'part-' || l_linenumber as name from lineitem where l_returnflag <> 'R'
          union select o_orderkey, 'report' from orders where o_orderstatus = 'F')
    select job, name from e except select job, name from d""")
def delivery_gaps(spark: SparkSession, folder: str) -> DataFrame:
    lines, orders = load(spark, folder, "lineitem"), load(spark, folder, "orders")

    def names(lines: DataFrame, orders: DataFrame) -> DataFrame:
        parts = lines.select(F.col("l_orderkey").alias("job"), F.concat(
            F.lit("part-"), F.col("l_linenumber").cast("string")).alias("name"))
        return parts.unionByName(orders.select(F.col("o_orderkey").alias("job"), F.lit("report").alias("name")))

    delivered = names(lines.filter("l_returnflag <> 'R'"), orders.filter("o_orderstatus = 'F'"))
    return R.delivery_gaps(names(lines, orders), delivered)


@query("select event_id, user_id, event_type from events where user_id in "
       "(select c_custkey from customer where c_mktsegment = 'BUILDING')")
def allow_list(spark: SparkSession, folder: str) -> DataFrame:
    users = load(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return R.allow_list(load(spark, folder, "events").select("event_id", "user_id", "event_type"), "user_id", users)


@query("select event_id, user_id, event_type from events where user_id in (3, 8, 46)")
def allow_list_named(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events").select("event_id", "user_id", "event_type")
    return R.allow_list(events, "user_id", [3, 8, 46])


def _stream(spark: SparkSession, folder: str, table: str = "events") -> DataFrame:
    """A provided table as a stream; times get the type that watermarks need."""
    schema = load(spark, folder, table).schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/{table}*.parquet")
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields
                               if isinstance(f.dataType, T.TimestampNTZType)})


def _replayed(spark: SparkSession, folder: str) -> DataFrame:
    """Every event arrives twice."""
    columns = ["event_id", "ts", "user_id", "event_type"]
    return _stream(spark, folder).select(columns).unionByName(_stream(spark, folder).select(columns))


@query("select distinct event_id, user_id, event_type from events")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    unique = dedup_stream(_replayed(spark, folder), "event_id", "ts", f"{R.RETENTION_DAYS} days")
    root = scratch_folder(spark, "dedup")
    return run_available(unique.drop("ts"), f"{root}/data", f"{root}/checkpoint")


@query("select distinct event_id, user_id, event_type from events")
def stream_dedup_exact(spark: SparkSession, folder: str) -> DataFrame:
    unique = dedup_stream(_replayed(spark, folder), "event_id").drop("ts")
    root = scratch_folder(spark, "dedup-exact")
    return run_available(unique, f"{root}/data", f"{root}/checkpoint")


_EVEN = "event_id % 2 = 0"


@query(f"""with w as (select max(ts) - interval 7 day as behind from events where {_EVEN})
    select event_id, event_id % 2 = 1 and ts < (select behind from w) as late,
    cast(case when {_EVEN} then 1 else 0 end as bigint) as replays from events""")
def stream_ingest_late(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the events arrive, then all of them in a later micro-batch after a restart: replays, and late first arrivals."""
    root = scratch_folder(spark, "late")
    events = load(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for batch in (events.where(_EVEN), events):
        batch.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        written = run_available(stream_ledger(stream, "event_id", "ts"), f"{root}/out", f"{root}/checkpoint", idle=False)
    return fold_ledger(written, "event_id", "ts").select("event_id", "late", "replays")


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_folder(spark, "upsert")
    last = stream_latest(_stream(spark, folder), "user_id", "event_id", ["event_type"])
    ingest(last, f"{root}/data", f"{root}/checkpoint").awaitTermination()
    return fold_batches(spark.read.parquet(f"{root}/data"), "user_id")


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def upsert_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Latest rows after three batches, one of them repeated, with a snapshot after two and one after all."""
    path = scratch_folder(spark, "snapshots")
    events = load(spark, folder, "events").select("user_id", "event_id", "event_type")
    for number in (0, 1, 1, 2):
        store_batch(events.where(F.col("event_id") % 3 == number), path, number)
        if number:
            compact(spark, path, "user_id", "event_id")
    return read_latest(spark, path, "user_id", "event_id")


_TEXT = ("select case when event_id % 11 = 0 then '' else event_id::varchar end as id, "
         "case when event_id % 11 = 0 then '  ' else ' ' || event_type || ' ' end as kind, "
         "case when event_id % 11 = 0 then '' when event_id % 5 = 0 then '=' || event_type else '-' || event_id end as note "
         "from events")


@query(f"with e as ({_TEXT}) select {Q.strip('id')} as id, {Q.strip('kind')} as kind, {Q.guard(Q.strip('note'))} as note "
       f"from e where not {Q.all_blank(['id', 'kind', 'note'])}")
def stream_tidy(spark: SparkSession, folder: str) -> DataFrame:
    key, kind = F.col("event_id").cast("string"), F.col("event_type")
    empty = F.col("event_id") % 11 == 0
    cells = _stream(spark, folder).select(
        F.when(empty, "").otherwise(key).alias("id"),
        F.when(empty, "  ").otherwise(F.concat(F.lit(" "), kind, F.lit(" "))).alias("kind"),
        F.when(empty, "").when(F.col("event_id") % 5 == 0, F.concat(F.lit("="), kind))
        .otherwise(F.concat(F.lit("-"), key)).alias("note"))
    root = scratch_folder(spark, "tidy")
    return run_available(stream_clean(cells, "tidy"), f"{root}/data", f"{root}/checkpoint")


@query(f"""with e as (select o_orderkey, replace(cast(cast(o_totalprice as decimal(18,2)) as varchar), '.', ',') as total from orders)
    select cast(o_orderkey as varchar) as o_orderkey, {Q.converted('total', 'br_to_us')} as total from e""")
def stream_punctuation(spark: SparkSession, folder: str) -> DataFrame:
    total = F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    cells = _stream(spark, folder, "orders").select("o_orderkey", total.alias("total"))
    converted = stream_clean(C.stringify(cells), "punctuation", column="total", direction="br_to_us")
    root = scratch_folder(spark, "punctuation")
    return run_available(converted, f"{root}/data", f"{root}/checkpoint")
