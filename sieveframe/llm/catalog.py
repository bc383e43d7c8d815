"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveframe.llm import (cascade, decontamination, langid, lattice, minhash, mixture, negatives, packing, pseudonyms,
                            quantised, resampling, toxicity, urls)
from sieveframe.llm.tables import load

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


PSEUDONYM_KEY = "a key that only its holder knows"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
x as (select doc_id, len(s) as n, unnest(s) as h from s),
c as (select a.doc_id as a, b.doc_id as b, a.n + b.n as n, count(*) as k
  from x a join x b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2, 3),
l as (select a, b from c where 100 * k >= 85 * (n - k)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from s union select r.doc_id, e.b from r join e on r.root = e.a)
select s.doc_id, cast(len(any_value(s)) as bigint) as n_shingles, min(root) as component_id,
  s.doc_id = min(root) as kept
from s join r on s.doc_id = r.doc_id group by s.doc_id"""


@query(OP1_SQL)
def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, folder, "documents"))


def vocabulary(name: str = "byte_bpe_50k") -> packing.Vocabulary:
    import public_tokenizers as public

    return packing.Vocabulary(public.path(f"{name}.json"), public.path(f"{name}.tiktoken"), public.PATTERN)


@query()
def op8_pack_sum_of_squares(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(load(spark, folder, "documents"), vocabulary(), with_ids=False)


@query()
def op9_toxicity_ftrl(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(load(spark, folder, "documents"), load(spark, folder, "labels"))


OP4_SQL = f"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size,
    md5('mix:' || coalesce(cast(doc_id as varchar), '')) as key from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
    [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from d group by source),
f as (
  select *, 1.5 * sum(source_size) over () - coalesce(sum(2.0 * source_size) over (
      order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as free
  from s),
c as (select *, weight * rest > 2.0 * source_size * free as clamped from f),
t as (
  select source, source_size, case when clamped then 2.0 * source_size else weight * cast(
      1.5 * (select sum(source_size) from s) - coalesce((select sum(2.0 * source_size) from c where clamped), 0) as double)
    / cast((select sum(weight) from c where not clamped) as double) end as target from c),
p as (
  select d.*, t.source_size, cast(t.target as double) as target,
    floor(t.target / greatest(t.source_size, 1)) as whole,
    sum(size) over (partition by d.source order by key, size rows unbounded preceding) - size as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(whole * size
  + least(greatest(round(target - whole * source_size) - before, 0), size) as bigint) as taken from p"""


@query(OP4_SQL)
def op4_mix_to_target_weights(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    return mixture.mixture(docs, mixture.cycled_weights(docs, (3, 1, 2)), 1.5).drop("source")


@query()
def op5_language_id_ecoc(spark: SparkSession, folder: str) -> DataFrame:
    return langid.languages(load(spark, folder, "documents"))


@query()
def op7_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymised(load(spark, folder, "documents"), PSEUDONYM_KEY)


OP10_SQL = f"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
k as (select doc_id, text, w, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as g,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from w),
u as (select rowid_ as r, unnest(g) as g, unnest(range(1, len(g) + 1)) as i from (select row_number() over () as rowid_, g from k)),
x as (select count(*) over (partition by r, g) as n, r, i from u),
c as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from x where n > 1) group by r),
m as (
  select doc_id, text, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
    cast(len(string_split(text, chr(10))) as bigint) as n_lines
  from (select row_number() over () as r, * from k) k left join c on c.r = k.r),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed
  or 100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 30 * n_lines
  or word_chars < 3 * n_words or word_chars > 12 * n_words
  or 100 * len(regexp_extract_all(text, '[\\p{{L}}]+')) < 80 * n_words
  or 100 * len(regexp_extract_all(text, '\\p{{Lu}}')) > 40 * word_chars
  or 100 * len(regexp_extract_all(text, '!')) > 30 * n_words
  or 100 * len(regexp_extract_all(text, '(?m)^[\\x20\\x09]*[•*+-][\\x20\\x09]')) > 90 * n_lines
  or 100 * len(regexp_extract_all(text, '(?m)(?:\\.\\.\\.|…)$')) > 30 * n_lines) as kept
from b"""


@query(OP10_SQL)
def op10_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.quality(load(spark, folder, "documents"))


@query()
def op2_lattice_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.lattice_scores(load(spark, folder, "documents"), vocabulary("byte_bpe_multi_50k").ranks)


# The provided pages have neither fetch times nor lists, so both come from the pages by rule: a fetch day
# from the id, and list entries from the hosts and first path parts that occur.
_DAY = "date '2024-01-01' + cast({} as int)"
_HASH = "(length(host) * 31 + ascii(substr(host, 3, 1)) * 7 + ascii(substr(host, 9, 1)))"
_PLACES = "select distinct host, part, {h} as h from ({urls}) where host is not null"
_ENTRIES = f"""
select 'spam' as list_name, host as pattern, true as listed, {_DAY.format('h % 30')} as since from places
where host like '%casino%' or host like '%pills%' or host like '%bets%' or host like '%ads-%'
union all
select 'spam', host, false, {_DAY.format('200 + h % 60')} from places where host like '%casino%' or host like '%ads-%'
union all
select 'spam', host, true, {_DAY.format('300 + h % 20')} from places where host like '%casino%'
union all
select 'seasonal', substr(host, length(host) - 10), true, {_DAY.format('h % 366')} from places where h % 17 = 0
union all
select 'seasonal', substr(host, length(host) - 10), false, {_DAY.format('h % 366 + 4')} from places where h % 17 = 0
union all
select 'paths', host || '/' || part, true, {_DAY.format('(h * 5) % 366')} from places where h % 4 = 1 and part <> ''
union all
select 'paths', host || '/' || part, false, {_DAY.format('(h * 5) % 366 + 90')} from places where h % 8 = 1 and part <> ''
"""
_HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)"

OP3_SQL = f"""
with urls as (
  select page_id, url, {_DAY.format('page_id * 37 % 366')} as fetched, nullif(lower({_HOST}), '') as host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') as parts
  from pages),
places as ({_PLACES.format(h=_HASH, urls="select host, coalesce(parts[1], '') as part from urls")}),
entries as ({_ENTRIES}),
states as (select list_name, pattern, since, bool_and(listed) as listed from entries group by 1, 2, 3),
valid as (select * from (select *, lead(since) over (partition by list_name, pattern order by since) as until from states) where listed),
met as (
  select page_id, url, fetched, list_name, pattern from (select distinct page_id, url, fetched, host, parts from urls) u join valid v
  on since <= fetched and (until is null or fetched < until) and (host = pattern or ends_with(host, '.' || pattern)
    or starts_with(host || '/' || array_to_string(parts, '/') || '/', pattern || '/') and contains(pattern, '/'))),
found as (select page_id, url, fetched, count(distinct list_name) as n, min((list_name, pattern)) as least from met group by 1, 2, 3)
select u.page_id, u.url, u.host, u.fetched, n is not null as listed, coalesce(n, 0) as n_lists,
  struct_extract(least, 1) as first_list, struct_extract(least, 2) as first_pattern
from urls u left join found f on u.page_id is not distinct from f.page_id and u.url is not distinct from f.url
  and u.fetched is not distinct from f.fetched"""


@query(OP3_SQL)
def op3_url_lists_as_of_fetch(spark: SparkSession, folder: str) -> DataFrame:
    pages = load(spark, folder, "pages")
    captures = pages.select("page_id", "url", F.expr(_DAY.format("page_id * 37 % 366")).alias("fetched"))
    parts = F.filter(F.split(urls.path_of(F.col("url")), "/"), lambda x: x != "")
    found = captures.select(urls.host_of(F.col("url")).alias("host"), F.coalesce(F.get(parts, 0), F.lit("")).alias("part"))
    places = spark.sql(_PLACES.format(h=_HASH, urls="select * from {urls}"), urls=found)
    return urls.listed_at_fetch(captures, spark.sql(_ENTRIES.replace("places", "{places}"), places=places))


@query()
def op6_vector_near_dedup_pq(spark: SparkSession, folder: str) -> DataFrame:
    return quantised.near_vectors(load(spark, folder, "embeddings"))


LOW_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
# 3988292384 is the reversed polynomial of CRC-32.
OP11_SQL = f"""
with t as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select doc_id, regexp_extract_all({_LOWERED}, '{LOW_WORD}') as w from documents),
x as (select doc_id, unnest(w) as w from d),
y as (select unnest(regexp_extract_all({_LOWERED}, '{LOW_WORD}')) as w from benchmark),
h as (select w, hex(encode(w)) as h from (select w from x union select w from y)),
b as (select w, xor(list_reduce(list_transform(range(0, len(h) // 2 + 1), lambda i:
    case when i = 0 then 4294967295 else cast('0x' || substr(h, 2 * i - 1, 2) as bigint) end),
  lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 as b from h, t),
s as (select b, count(*) as n from x join b using (w) group by b),
g as (select b, count(*) as n from y join b using (w) group by b),
k as (select b.b, cast(floor(1000 * ln((coalesce(any_value(g.n), 0) + 1)::double * ((select count(*) from x) + 10000)::double
    / ((coalesce(any_value(s.n), 0) + 1)::double * ((select count(*) from y) + 10000)::double))) as bigint) as gain
  from (select distinct b from b) b left join s using (b) left join g using (b) group by b.b),
v as (select doc_id, sum(gain) as gain from x join b using (w) join k using (b) group by doc_id),
a as (select d.doc_id, cast(len(w) as bigint) as n_features, cast(floor(coalesce(v.gain, 0) / greatest(len(w), 1)) as bigint) as weight,
  cast('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) as bigint) as h from d left join v on d.doc_id = v.doc_id),
r as (select doc_id, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from a),
o as (select doc_id, row_number() over (order by score desc, doc_id) as rank from r where n_features >= 20)
select r.doc_id, n_features, weight, score,
  cast(case when o.rank <= (select count(*) from o) * 10 // 100 then o.rank end as bigint) as rank
from r left join o on r.doc_id = o.doc_id"""


@query(OP11_SQL)
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampling(load(spark, folder, "documents"), load(spark, folder, "benchmark")).drop("digest")


OP12_SQL = f"""
with d as (select doc_id, regexp_extract_all({_LOWERED}, '{LOW_WORD}') as w from documents),
i as (select item_id, regexp_extract_all({_LOWERED}, '{LOW_WORD}') as w from benchmark),
n as (select distinct item_id, len as n, array_to_string(w[p:p + len - 1], ' ') as g from (
  select item_id, w, least(len(w), 10) as len, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from i where len(w) > 0)),
x as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as g from (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from n) where len(w) >= n)),
m as (select doc_id, p, x.n, item_id from x join n using (n, g)),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from m) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (
  select distinct doc_id, cast(item_id as varchar) as item from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join c on d.doc_id = c.doc_id left join t on d.doc_id = t.doc_id"""


@query(OP12_SQL)
def op12_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(load(spark, folder, "documents"), load(spark, folder, "benchmark"))


OP13_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from (select anchor_id, vec_id as positive_id, score as positive_score,
    row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same) where place <= 5),
n as (select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from p join s on p.anchor_id = s.anchor_id and not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10"""


@query(OP13_SQL)
def op13_slotted_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = load(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved))
