"""Queries for cell text of typed values, names, HTML, links, paths and commands."""

from __future__ import annotations

import html
import html.entities
import json
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveframe.catalog import sqltext as Q
from sieveframe.catalog.base import load, query
from sieveframe.functions import cells as C
from sieveframe.functions import text as X


@query(f"select {Q.float_text('o_orderkey')} as o_orderkey, {Q.float_text('o_custkey')} as o_custkey, o_orderstatus, "
       f"{Q.float_text('o_totalprice')} as o_totalprice, {Q.moment_text('o_orderdate')} as o_orderdate, "
       "o_orderpriority from orders")
def stringify_orders(spark: SparkSession, folder: str) -> DataFrame:
    return C.stringify(load(spark, folder, "orders"))


@query(f"select {Q.float_text('event_id')} as event_id, {Q.moment_text('ts')} as ts, {Q.float_text('user_id')} as user_id, "
       f"event_type, {Q.float_text('value')} as value, coalesce(props, '') as props from events")
def stringify_events(spark: SparkSession, folder: str) -> DataFrame:
    return C.stringify(load(spark, folder, "events"))


_SCALES = [1e-12, 1e-4, 1e-3, 1.0, 1e3, 1e8, 1e14]


@query("select " + ", ".join(
    f"cast(l_extendedprice * cast({scale!r} as double) as varchar) as x{i}" for i, scale in enumerate(_SCALES))
    + " from lineitem")
def float_texts(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice")
    lines = load(spark, folder, "lineitem")
    return C.stringify(lines.select(*[(price * F.lit(scale)).alias(f"x{i}") for i, scale in enumerate(_SCALES)]))


@query("select o_orderkey, '[{\"key\": ' || o_orderkey || ', \"status\": \"' || o_orderstatus || '\", \"day\": \"' "
       "|| strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '\"}, null]' as nested from orders")
def nested_text(spark: SparkSession, folder: str) -> DataFrame:
    item = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"),
                    F.col("o_orderdate").alias("day"))
    nested = load(spark, folder, "orders").select("o_orderkey", F.array(item, F.lit(None)).alias("nested"))
    return nested.select("o_orderkey", C.to_text(F.col("nested"), nested.schema["nested"].dataType).alias("nested"))


@query("select cast(vec_id as varchar) as vec_id, '[' || array_to_string(list_transform(embedding, "
       "lambda x: cast(cast(x as double) as varchar)), ', ') || ']' as embedding, cast(label as varchar) as label from embeddings")
def stringify_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return C.stringify(load(spark, folder, "embeddings"))


@query("select o_orderkey, case when o_totalprice is null then 'não disponível' else "
       "translate(regexp_replace(format('{:,.4f}', cast(cast(o_totalprice as decimal(18,2)) as double)), '\\.?0+$', ''), "
       "',.', '.,') end as total from orders")
def number_text(spark: SparkSession, folder: str) -> DataFrame:
    total = F.col("o_totalprice").cast("decimal(18,2)")
    return load(spark, folder, "orders").select("o_orderkey", C.number_text(total).alias("total"))


def _latin_folding() -> tuple[str, str]:
    """Accented Latin letters and the letters below the accents, from the character names."""
    letters = []
    for ch in map(chr, range(0xC0, 0x180)):
        words = unicodedata.name(ch).split(" WITH ")
        if len(words) == 2 and words[1] != "STROKE" and words[0].startswith("LATIN "):
            base = words[0].split()[-1]
            if len(base) == 1:
                letters.append((ch, base.lower() if "SMALL" in words[0] else base))
    return "".join(a for a, _ in letters), "".join(b for _, b in letters)


def _slug_sql(v: str) -> str:
    accented, bare = _latin_folding()
    ascii_only = f"regexp_replace(translate({v}, '{accented}', '{bare}'), '[^\\x00-\\x7f]+', '', 'g')"
    words = f"trim(regexp_replace(lower({ascii_only}), '[^a-z0-9]+', '_', 'g'), '_')"
    return f"case when {words} = '' then 'column' else {words} end"


@query(f"select doc_id, {_slug_sql('text')} as slug from documents")
def slug_text(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "documents").select("doc_id", X.slug_col(F.col("text")).alias("slug"))


@query(f"select conv_id, turn, replace({_slug_sql('text')}, '_', ' ') as words from conversations")
def norm_text(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "conversations").select("conv_id", "turn", X.norm(F.col("text")).alias("words"))


def _html_sql(v: str) -> str:
    steps = v
    for pattern, new in [
            ("(?s)<!--.*?-->", "\ufdd0"),
            (r"(?is)<script(\s[^>]*)?>.*?</script\s*>", "\ufdd0"),
            (r"(?is)<style(\s[^>]*)?>.*?</style\s*>", "\ufdd0"),
            (r"(?i)</(p|div|tr|br)(\s[^>]*)?>", "\ufdd1"),
            (r"(?i)<(p|div|tr|br)(\s[^>]*)?/>", "\ufdd1"),
            (r"<[a-zA-Z/!?]([^>=]|=\s*\"[^\"]*\"|=\s*''[^'']*''|=)*>", "\ufdd0"),
            ("([^\ufdd0\ufdd1<]+|<)", "\\1 ")]:
        steps = f"regexp_replace({steps}, '{pattern}', '{new}', 'g')"
    for name in ("copy", "middot", "quot", "lt", "gt", "nbsp", "amp"):
        steps = f"replace({steps}, '&{name};', '{chr(html.entities.name2codepoint[name])}')"
    return f"replace(replace({steps}, '\ufdd0', ''), '\ufdd1', chr(10))"


# Every name of HTML 5 as it is and with letters after it, and numbers that browsers read in their own way.
_REFERENCES = [*(f"&{n}" for n in sorted(html.entities.html5)), *(f"&{n}xyz" for n in sorted(html.entities.html5)),
               *(f"&#{n};" for n in (0, 1, 9, 65, 127, 128, 129, 150, 159, 233, 55296, 64976, 65534, 128512, 1114112, 99999999999999999999)),
               *(f"&#x{n}" for n in ("41", "80;", "9F ", "1F600;", "D800;", "FFFFFFFFFFFFFFFF;", "0000041;")), "&#;", "&#x;", "&", "& ", "&nothing;"]


def _sql_texts(texts: list[str]) -> str:
    """A list of texts as SQL, whatever their characters."""
    return "[" + ", ".join("decode(from_hex('" + t.encode().hex() + "'))" for t in texts) + "]"


@query(f"""with r as (select {_sql_texts([html.unescape("&gt" + r) for r in _REFERENCES])} as list)
    select o_orderkey, '<' || o_orderstatus || list[o_orderkey % {len(_REFERENCES)} + 1] || ' & ' || o_orderstatus as text from orders, r""")
def html_references(spark: SparkSession, folder: str) -> DataFrame:
    listed = F.from_json(F.lit(json.dumps(_REFERENCES)), "array<string>")
    source = F.concat(F.lit("&lt;"), "o_orderstatus", F.lit("&gt"), F.get(listed, (F.col("o_orderkey") % len(_REFERENCES)).cast("int")),
                      F.lit(" &amp; "), "o_orderstatus")
    return load(spark, folder, "orders").select("o_orderkey", X.decode_entities(source).alias("text"))


@query(f"select page_id, {_html_sql('html')} as text from pages")
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query("select page_id, rtrim(regexp_extract('see (' || url || ').', 'https?://\\S+', 0), '),.') as link from pages "
       "union all select doc_id, rtrim(regexp_extract(text, 'https?://\\S+', 0), '),.') from documents")
def links_in_text(spark: SparkSession, folder: str) -> DataFrame:
    quoted = F.concat(F.lit("see ("), F.col("url"), F.lit(")."))
    pages = load(spark, folder, "pages").select("page_id", X.first_link(quoted).alias("link"))
    documents = load(spark, folder, "documents").select("doc_id", X.first_link(F.col("text")).alias("link"))
    return pages.unionAll(documents)




@query("""with u as (select page_id, unnest(['plain', 'port', 'user', 'port_443', 'ftp', 'no_scheme']) as form, unnest([url,
      regexp_replace(url, '^(https?://[^/]+)', '\\1:8080'), replace(url, '://', '://ana:x@'),
      regexp_replace(url, '^(https?://[^/]+)', '\\1:443'), regexp_replace(url, '^https?', 'ftp'),
      regexp_replace(url, '^https?://', '')]) as url from pages),
    p as (select page_id, form, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) as scheme,
      regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) as authority from u)
    select page_id, form, scheme in ('http', 'https') and position('@' in authority) = 0
      and split_part(authority, ':', 1) <> '' and split_part(authority, ':', 2) in ('', '80', '443') as accepted from p""")
def url_policy(spark: SparkSession, folder: str) -> DataFrame:
    url = F.col("url")
    forms = {
        "plain": url, "port": F.regexp_replace(url, "^(https?://[^/]+)", "$1:8080"),
        "user": F.replace(url, F.lit("://"), F.lit("://ana:x@")),
        "port_443": F.regexp_replace(url, "^(https?://[^/]+)", "$1:443"),
        "ftp": F.regexp_replace(url, "^https?", "ftp"), "no_scheme": F.regexp_replace(url, "^https?://", ""),
    }
    variants = F.create_map(*[p for name, form in forms.items() for p in (F.lit(name), form)])
    urls = load(spark, folder, "pages").select("page_id", F.explode(variants).alias("form", "url"))
    return urls.select("page_id", "form", X.url_ok(F.col("url")).alias("accepted"))


_MIME_SQL = ("case page_id % 4 when 0 then 'text/html; charset=utf-8' when 1 then 'text/csv' when 2 then 'image/png' "
             "else 'application/pdf' end")


@query(f"""with u as (select page_id, {_MIME_SQL} as mime, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as path from pages
      union all select doc_id, 'text/csv', 'in/' || source || case doc_id % 3 when 0 then '.Parquet' when 1 then '.tar.gz' else '' end
      from documents),
    s as (select *, lower(regexp_extract(path, '[^/](\\.[^./]+)/*$', 1)) as suffix from u)
    select page_id as id, case when suffix in ('.csv','.tsv','.xlsx','.xls','.parquet','.pdf','.txt','.html','.htm') then suffix
      when mime like 'text/html%' then '.html' when mime = 'text/csv' then '.csv' when mime = 'application/pdf' then '.pdf'
      else '.txt' end as kind from s""")
def file_kind(spark: SparkSession, folder: str) -> DataFrame:
    page = F.col("page_id") % 4
    mime = (F.when(page == 0, "text/html; charset=utf-8").when(page == 1, "text/csv").when(page == 2, "image/png")
            .otherwise("application/pdf"))
    pages = load(spark, folder, "pages").select(
        F.col("page_id").alias("id"), X.file_kind(F.col("url"), mime).alias("kind"))
    third = F.col("doc_id") % 3
    path = F.concat(F.lit("in/"), F.col("source"), F.when(third == 0, ".Parquet").when(third == 1, ".tar.gz").otherwise(""))
    documents = load(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), X.file_kind(path, F.lit("text/csv")).alias("kind"))
    return pages.unionAll(documents)


_PREFIXES = ["", "/review ", "/csReview@TableBot ", "/decimais valor br_para_us ", "/arrumar@OtherBot ",
             "/separador ponto_virgula https://example.com/a.csv ", "  /Diagnostico"]
_PREFIX_SQL = "case (conv_id + turn) % 7 " + " ".join(
    f"when {i} then '{p}'" for i, p in enumerate(_PREFIXES)) + " end"
_COMMAND_SQL = f"""
    m as (select conv_id, turn, {_PREFIX_SQL} || case when (conv_id + turn) % 7 in (0, 4) then text else '' end as text
          from conversations),
    t as (select conv_id, turn, regexp_extract(text, '^\\s*(\\S+)', 1) as first,
                 list_filter(str_split_regex(regexp_replace(text, '^\\s*\\S+', ''), '\\s+'),
                             lambda w: w <> '' and not regexp_matches(w, '^https?://')) as rest from m),
    w as (select *, lower(regexp_extract(first, '^/([^@]*)', 1)) as word, regexp_extract(first, '@(.*)$', 1) as bot from t),
    c as (select *, case when left(first, 1) <> '/' then ''
                 when position('@' in first) > 0 and lower(bot) <> 'tablebot' then null
                 else case word when 'review' then 'diagnostico' when 'csreview' then 'arrumar'
                                when 'decimais' then 'pontuacao' else word end end as command from w)"""


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    case = (F.col("conv_id") + F.col("turn")) % 7
    prefix = F.element_at(F.array(*map(F.lit, _PREFIXES)), (case + 1).cast("int"))
    body = F.when(case.isin(0, 4), F.col("text")).otherwise("")
    return load(spark, folder, "conversations").select("conv_id", "turn", F.concat(prefix, body).alias("text"))


@query(f"with {_COMMAND_SQL} select conv_id, turn, command from c")
def command_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _messages(spark, folder).select("conv_id", "turn", X.command(F.col("text"), "TableBot").alias("command"))


@query(f"""with {_COMMAND_SQL} select conv_id, turn,
    case command when 'diagnostico' then 'profile' when 'arrumar' then 'tidy' when 'pontuacao' then 'punctuation'
                 when 'separador' then 'delimiter' end as operation,
    case when command = 'separador' and rest[1] = 'ponto_virgula' then ';' end as delimiter,
    case when command = 'pontuacao' then rest[1] end as "column",
    case when command = 'pontuacao' and rest[2] = 'br_para_us' then 'br_to_us' end as direction,
    coalesce(case command when 'separador' then len(rest) = 1 when 'pontuacao' then len(rest) = 2
             when 'diagnostico' then len(rest) = 0 when 'arrumar' then len(rest) = 0 else false end, false) as accepted
    from c""")
def command_requests(spark: SparkSession, folder: str) -> DataFrame:
    return _messages(spark, folder).select("conv_id", "turn", F.inline(F.array(X.request(F.col("text"), "TableBot"))))
