"""URL lists as of the time of the fetch: dated entries become validity intervals, joined by key and time.

An entry puts a pattern on a list or takes it off at a time; a pattern is a domain (it covers its
subdomains) or a domain with a path prefix. The entries of one pattern, in order of time, give intervals
in which it is active. A capture has a key for each parent domain of its host and for each prefix of its
path, and meets the intervals of these keys that hold at its fetch. The join is on the key and a bucket of
days, so that a long history or a host with a third of all captures is met in pieces.

Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveframe.operators.joins import BROADCAST_ROWS

DAYS = 32  # width of a bucket


def host_of(url: Column) -> Column:
    """Host of an absolute URL in lower case, without user, port or last dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    """Path of an absolute URL, from its first slash; empty if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column) -> Column:
    """All patterns that cover a host and path: parent domains, and the host with each path prefix."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)),
                           lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.array_distinct(F.concat(domains, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """``list_name, pattern, since, until`` in which ``entries(list_name, pattern, listed, since)`` hold.

    ``listed`` is true for an entry that puts the pattern on the list and false for one that takes it
    off; of entries at one time, taking off wins. ``until`` is exclusive and null while no later entry
    ends it. Entries with a null in any of the four columns are ignored; a pattern is lower-cased up to
    its path and loses a last slash.
    """
    known = entries.where("list_name is not null and pattern is not null and listed is not null and since is not null")
    domain = F.lower(F.regexp_extract("pattern", "^[^/]*", 0))
    rest = F.rtrim(F.regexp_extract("pattern", "/.*$", 0), F.lit("/"))
    pattern = F.when(F.col("pattern").contains("/") & (rest == ""), F.concat(domain, F.lit("/"))).otherwise(F.concat(domain, rest))
    states = known.select("list_name", pattern.alias("pattern"), "listed", "since") \
        .groupBy("list_name", "pattern", "since").agg(F.min("listed").alias("listed"))
    history = Window.partitionBy("list_name", "pattern").orderBy("since")
    return states.withColumn("until", F.lead("since").over(history)).where("listed").drop("listed")


def listed_at_fetch(captures: DataFrame, entries: DataFrame, days: int = DAYS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id, url, host, fetched, listed, n_lists, first_list, first_pattern`` of every capture.

    ``captures(page_id, url, fetched)`` and ``entries`` have dates or timestamps of one type. A capture
    is listed if any list has an active pattern for it; the first list and pattern are the least in
    code-point order. A null or relative URL has no host, and with a null fetch time it is on no list.
    Repeated rows come out alike, as often as they come in. Other columns are ignored.
    """
    rows = captures.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host")) \
        .withColumn("row_key", F.xxhash64("page_id", "url", "fetched"))
    valid = intervals(entries)
    range_ = rows.agg(F.min("fetched").alias("first"), F.max("fetched").alias("last")).first()

    def bucket(time: Column) -> Column:
        return F.floor(F.datediff(time, F.lit("1970-01-01").cast("date")) / days)

    # Only buckets that hold captures are of use, which bounds the number of buckets of an open interval.
    since, until = F.greatest("since", F.lit(range_.first)), F.least(F.coalesce("until", F.lit(range_.last)), F.lit(range_.last))
    dealt = valid.where((F.col("since") <= F.lit(range_.last)) & (F.col("until").isNull() | (F.col("until") > F.lit(range_.first)))) \
        .withColumn("bucket", F.explode(F.sequence(bucket(since), bucket(until))))
    small = dealt.limit(broadcast_rows + 1).count() <= broadcast_rows
    right = F.broadcast(dealt) if small else dealt
    keyed = rows.where("host is not null and fetched is not null").select(
        "row_key", "page_id", "url", "fetched", bucket(F.col("fetched")).alias("bucket"),
        F.explode(keys_of(F.col("host"), path_of(F.col("url")))).alias("pattern"))
    met = keyed.join(right, ["pattern", "bucket"]).where("since <= fetched and (until is null or fetched < until)")
    columns = ("page_id", "url", "fetched")
    found = met.groupBy("row_key", *columns).agg(
        F.countDistinct("list_name").alias("n"), F.min(F.struct("list_name", "pattern")).alias("least")) \
        .withColumnsRenamed({c: f"met_{c}" for c in columns})
    same = [F.col(c).eqNullSafe(F.col(f"met_{c}")) for c in columns]
    return rows.alias("r").join(found.alias("f"), (F.col("r.row_key") == F.col("f.row_key")) & same[0] & same[1] & same[2], "left") \
        .select("page_id", "url", "host", "fetched", F.col("n").isNotNull().alias("listed"),
                F.coalesce("n", F.lit(0)).cast("long").alias("n_lists"), F.col("least.list_name").alias("first_list"),
                F.col("least.pattern").alias("first_pattern"))
