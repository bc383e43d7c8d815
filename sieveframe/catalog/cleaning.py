"""Queries for the cleaning operations, the profile and the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveframe.catalog import sqltext as Q
from sieveframe.catalog.base import DIRTY_COLUMNS, D, dirty_orders, dirty_sql, load, query
from sieveframe.functions import cells as C
from sieveframe.operators.profile import (
    SUMMARY_COLUMNS, cell_facts, column_stats, fold_facts, invalid_dates as total_invalid_dates, missing_report as missing_of,
    mixed_type_columns as mixed_of, profile)
from sieveframe.operators.rows import duplicate_count as count_duplicates, first_copies
from sieveframe.operators.totals import exact_totals
from sieveframe.plans.clean import clean, reconcile as reconciled
from sieveframe.plans.questions import asked_column as column_asked, duplicates_found, missing_cells, table_size
from sieveframe.session import scratch_folder
from sieveframe.sinks.parts import write_result
from sieveframe.sources.tables import as_table

CELLS = ", ".join(DIRTY_COLUMNS)
WITH_D = f"with d as ({D}) "
TIDY = f"select {Q.select_cells(Q.strip)} from d where not {Q.all_blank()}"
GUARDED = f"select {Q.select_cells(Q.guard)} from (select {Q.select_cells(Q.strip)} from d where not {Q.all_blank()}) t"


@query(WITH_D + GUARDED)
def tidy_rows(spark: SparkSession, folder: str) -> DataFrame:
    return clean(dirty_orders(spark, folder), "tidy").data


@query(f"with d as ({D}), u as (select distinct {CELLS} from ({TIDY}) t) select {Q.select_cells(Q.guard)} from u")
def tidy_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return clean(dirty_orders(spark, folder), "tidy", deduplicate=True).data


@query(WITH_D + f"select {Q.select_cells(Q.strip)} from d")
def trim_cells(spark: SparkSession, folder: str) -> DataFrame:
    return clean(dirty_orders(spark, folder), "trim").data


@query(f"with d as ({D}), x as (select unnest([{', '.join(repr(c) for c in DIRTY_COLUMNS)}]) as column_name, "
       f"unnest([{CELLS}]) as v from d) select column_name, cast(count(*) filter ({Q.strip('v')} <> v) as bigint) "
       "as trimmed from x group by column_name")
def trim_changes(spark: SparkSession, folder: str) -> DataFrame:
    d = dirty_orders(spark, folder)
    cells = d.select(F.explode(F.create_map(*[p for c in DIRTY_COLUMNS for p in (F.lit(c), F.col(c))]))
                     .alias("column_name", "v"))
    return cells.groupBy("column_name").agg(F.count_if(C.strip(F.col("v")) != F.col("v")).alias("trimmed"))


@query(WITH_D + f"select {CELLS} from d where not {Q.all_blank()}")
def drop_empty_rows(spark: SparkSession, folder: str) -> DataFrame:
    return clean(dirty_orders(spark, folder), "drop_empty").data


@query(WITH_D + f"select distinct {CELLS} from d")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return clean(dirty_orders(spark, folder), "dedup").data


@query(WITH_D + f"""select cast(sum(n) as bigint) as "rows", cast(sum(n - 1) as bigint) as duplicates
                    from (select count(*) as n from d group by {CELLS}) g""")
def duplicate_count(spark: SparkSession, folder: str) -> DataFrame:
    return count_duplicates(dirty_orders(spark, folder))


def _punctuation_sql(direction: str, *marks: str) -> str:
    cell = Q.converted("amount_br", direction)
    return f"with d as ({dirty_sql(*marks)}) select id, priority, amount, {cell} as amount_br, odate from d"


@query(_punctuation_sql("br_to_us"))
def punctuation_br_to_us(spark: SparkSession, folder: str) -> DataFrame:
    return clean(dirty_orders(spark, folder), "punctuation", column="amount_br", direction="br_to_us").data


@query(_punctuation_sql("us_to_br", ",", "."))
def punctuation_us_to_br(spark: SparkSession, folder: str) -> DataFrame:
    d = dirty_orders(spark, folder, ",", ".")
    return clean(d, "punctuation", column="amount_br", direction="us_to_br").data


@query(f"""with d as ({D}) select
       cast(count(*) filter ({Q.converted('amount_br', 'br_to_us')} <> amount_br) as bigint) as punctuation,
       cast(count(*) filter (amount_br <> '' and not {Q.converts('amount_br', 'br_to_us')}) as bigint)
         as ignored_conversions from d""")
def punctuation_counts(spark: SparkSession, folder: str) -> DataFrame:
    result = clean(dirty_orders(spark, folder), "punctuation", column="amount_br", direction="br_to_us")
    return result.report.select("changes.punctuation", "ignored_conversions")


@query(f"with d as ({D}), t as ({TIDY}) select amount, {Q.guard('amount')} as guarded from t where {Q.needs_guard('amount')}")
def formula_guard(spark: SparkSession, folder: str) -> DataFrame:
    d = dirty_orders(spark, folder)
    amount = C.strip(F.col("amount"))
    return d.filter(C.needs_guard(amount)).select(amount.alias("amount"), C.guard(amount).alias("guarded"))


@query(f"with d as ({D}), {Q.cells_cte('d', DIRTY_COLUMNS)} select column_name as \"column\", v as cell, "
       f"k as \"class\", {Q.comma_number('v')} as is_comma_number from cells")
def cell_class(spark: SparkSession, folder: str) -> DataFrame:
    d = dirty_orders(spark, folder)
    cells = d.select(F.explode(F.create_map(*[p for c in DIRTY_COLUMNS for p in (F.lit(c), F.col(c))]))
                     .alias("column", "raw"))
    shown = cells.select("column", C.blank_to_empty(F.col("raw")).alias("cell"))
    return shown.select("column", "cell", C.cell_class(F.col("cell")).alias("class"),
                        C.is_comma_number(F.col("cell")).alias("is_comma_number"))


@query(f"""with d as ({D}), t as (
    select unnest([odate, odate || 'T10:11:12', odate || ' 25:00', odate || 'T10:11:12.5+03:00', odate || 'T1011Z',
                   odate || 'x', replace(odate, '-', '/')]) as odate from d)
    select odate, {Q.iso_valid('odate')} as valid from t""")
def iso_dates(spark: SparkSession, folder: str) -> DataFrame:
    odate = F.col("odate")
    forms = [odate, *[F.concat(odate, F.lit(s)) for s in ("T10:11:12", " 25:00", "T10:11:12.5+03:00", "T1011Z", "x")],
             F.replace(odate, F.lit("-"), F.lit("/"))]
    d = dirty_orders(spark, folder).select(F.explode(F.array(*forms)).alias("odate"))
    return d.select("odate", C.iso_valid(odate).alias("valid"))


def flat_profile(profiled: DataFrame) -> DataFrame:
    """The profile with one column per class, and the mean as a double rounded for comparison."""
    def kind(name: str):
        return F.coalesce(F.try_element_at("types", F.lit(name)), F.lit(0)).cast("bigint")

    mean = F.when(F.col("numeric") > 0, F.round(F.col("sum_num").cast("double") / F.col("numeric"), 6))
    return profiled.select(
        "column", "position", "missing", "leading_zero", F.col("numeric").alias("numeric_cells"), "number_inexact",
        kind("iso_date").alias("iso_date"), "invalid_date", kind("text").alias("text_cells"), "negative",
        "comma_number", "min_num", "max_num", "sum_num", mean.alias("mean_num"), "mixed_type")


@query(Q.profile_sql(f"d as ({D})", "d", DIRTY_COLUMNS))
def column_profile(spark: SparkSession, folder: str) -> DataFrame:
    return flat_profile(profile(dirty_orders(spark, folder)))


@query(Q.profile_sql(f"d as ({D}), t as ({TIDY})", "t", DIRTY_COLUMNS))
def tidy_profile(spark: SparkSession, folder: str) -> DataFrame:
    return flat_profile(clean(dirty_orders(spark, folder), "tidy").profile)


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_TEXT = "select " + ", ".join(
    f"{Q.moment_text(c)} as {c}" if c == "l_shipdate" else f"{Q.float_text(c)} as {c}" for c in LINEITEM
) + " from lineitem"


@query(Q.profile_sql(f"t as ({LINEITEM_TEXT})", "t", LINEITEM))
def profile_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return flat_profile(profile(load(spark, folder, "lineitem")))


def doubles(profiled: DataFrame, digits: int) -> DataFrame:
    """The statistics as doubles, rounded for comparison with sums that are added in another order."""
    return profiled.select("column", F.col("numeric").alias("numeric_cells"), "number_inexact", *[
        F.round(c, digits).alias(c) for c in ("min_double", "max_double", "sum_double", "mean_double")])


def doubles_sql(relation: str, columns: dict[str, str], digits: int, repeat: int = 1) -> str:
    """Statistics of expressions over typed columns, without any text; all their texts are inexact or not by rule."""
    return " union all ".join(
        f"select '{name}' as \"column\", cast(count(v) * {repeat} as bigint) as numeric_cells, "
        f"cast(count(*) filter (not regexp_full_match(cast(v as varchar), '[+-]?[0-9]{{1,18}}(\\.[0-9]{{0,10}})?')) * {repeat} as bigint) "
        f"as number_inexact, round(min(cast(v as double)), {digits}) as min_double, round(max(cast(v as double)), {digits}) as max_double, "
        f"round(sum(cast(v as double)) * {repeat}, {digits}) as sum_double, round(avg(cast(v as double)), {digits}) as mean_double "
        f"from (select {expression} as v from {relation}) x" for name, expression in columns.items())


@query(doubles_sql("lineitem", {"third": "l_extendedprice / 3", "product": "l_extendedprice * (1 - l_discount)"}, 2))
def profile_doubles(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = load(spark, folder, "lineitem")
    return doubles(profile(lineitem.selectExpr("l_extendedprice / 3 as third", "l_extendedprice * (1 - l_discount) as product")), 2)


@query(doubles_sql("(select unnest(embedding) as e from embeddings) y", {"element": "cast(e as double)"}, 3))
def profile_floats(spark: SparkSession, folder: str) -> DataFrame:
    return doubles(profile(load(spark, folder, "embeddings").select(F.explode("embedding").alias("element"))), 3)


@query("""select status, priority, day, place, cast(row_number() over (order by place) as bigint) as position from (
  select o_orderstatus as status, o_orderpriority as priority, cast(day(o_orderdate) as bigint) as day, min(o_orderkey) as place
  from orders group by 1, 2, 3) x""")
def dedup_in_order(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "orders").selectExpr(
        "o_orderstatus as status", "o_orderpriority as priority", "cast(day(o_orderdate) as bigint) as day", "o_orderkey as place")
    kept = first_copies(lines, ["place"])
    # One row for each combination, some hundred: numbered in the order in which a file of them is written.
    at = scratch_folder(spark, "in-order")
    kept.write.csv(at)
    files = spark.read.csv(at, schema=kept.schema).select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    return files.select(*kept.columns, F.row_number().over(Window.orderBy("file", "line")).cast("long").alias("position"))


# Each row stands for 3 * 10^10 copies, so that the total is over 10^27, which the decimal cannot hold.
_COPIES = 3 * 10**10


@query(f"select 'id' as \"column\", count(*) * {_COPIES} as numeric_cells, min(id) as min_num, max(id) as max_num, "
       f"cast(null as decimal(38,10)) as sum_num, round(sum(cast(id as double)) * {_COPIES} / 1e24) as sum_double "
       "from (select cast(999999999999000000 + l_orderkey as decimal(38,10)) as id from lineitem) x")
def profile_large_ids(spark: SparkSession, folder: str) -> DataFrame:
    ids = load(spark, folder, "lineitem").selectExpr("cast(999999999999000000 + l_orderkey as string) as id")
    facts = fold_facts(cell_facts(ids, ["id"], F.lit(_COPIES)), ["id"])
    return facts.select("column", F.col("numeric").alias("numeric_cells"), "min_num", "max_num", "sum_num",
                        F.round(F.col("sum_double") / 1e24).alias("sum_double"))


@query(Q.profile_sql(f"t as ({LINEITEM_TEXT})", "t", LINEITEM))
def tidy_lineitem_profile(spark: SparkSession, folder: str) -> DataFrame:
    return flat_profile(clean(load(spark, folder, "lineitem"), "tidy").profile)


@query(LINEITEM_TEXT)
def tidy_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return clean(load(spark, folder, "lineitem"), "tidy").data


def _missing_sql(limit: str = "") -> str:
    return f"""with d as ({D}), {Q.cells_cte('d', DIRTY_COLUMNS)}
        select column_name as "column", cast(position as integer) as position,
               cast(count(*) filter (k = 'missing') as bigint) as missing,
               round(100.0 * cast(count(*) filter (k = 'missing') as double)
                     / (select greatest(count(*), 1) from d), 1) as percent
        from cells group by all having count(*) filter (k = 'missing') > 0 order by position {limit}"""


@query(_missing_sql())
def missing_report(spark: SparkSession, folder: str) -> DataFrame:
    return missing_cells(clean(dirty_orders(spark, folder), "missing").report)


@query(_missing_sql(f"limit {SUMMARY_COLUMNS}"))
def missing_summary(spark: SparkSession, folder: str) -> DataFrame:
    d = dirty_orders(spark, folder)
    report = clean(d, "missing").report
    return missing_of(report.select("rows_evaluated", F.inline("profile")), F.col("rows_evaluated"), SUMMARY_COLUMNS)


@query(f"with d as ({D}), {Q.cells_cte('d', DIRTY_COLUMNS)} select cast(count(*) filter (k = 'invalid_date') "
       "as bigint) as invalid_dates from cells")
def invalid_dates(spark: SparkSession, folder: str) -> DataFrame:
    return total_invalid_dates(profile(dirty_orders(spark, folder)))


@query(f"with d as ({D}), {Q.cells_cte('d', DIRTY_COLUMNS)} select column_name as \"column\", "
       "cast(position as integer) as position from cells group by all "
       "having count(*) filter (k = 'number') > 0 and count(*) filter (k = 'text') > 0")
def mixed_type_columns(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_of(profile(dirty_orders(spark, folder)))


def _number_text_sql(v: str) -> str:
    grouped = f"regexp_replace(format('{{:,.4f}}', cast({v} as double)), '\\.?0+$', '')"
    return (f"case when {v} is null then 'não disponível' else translate({grouped}, ',.', '.,') end")


_STATS = ["missing", "leading_zero", "negative", "comma_number", "invalid_date"]


@query(f"""with d as ({D}), p as ({Q.profile_sql(f'd as ({D})', 'd', DIRTY_COLUMNS)})
    select "column", {', '.join(_STATS)}, {_number_text_sql('min_num')} as min_num_text,
           {_number_text_sql('max_num')} as max_num_text from p where "column" = 'amount'""")
def column_facts(spark: SparkSession, folder: str) -> DataFrame:
    stats = column_stats(profile(dirty_orders(spark, folder)), "amount")
    return stats.select("column", *_STATS, "min_num_text", "max_num_text")


@query(f"""with d as ({D}), p as ({Q.profile_sql(f'd as ({D})', 'd', DIRTY_COLUMNS)})
    select "column", {', '.join(_STATS)} from p
    where regexp_matches('qual a media de amount br', '\\b' || replace("column", '_', ' ') || '\\b')
    order by position limit 1""")
def asked_column(spark: SparkSession, folder: str) -> DataFrame:
    report = clean(dirty_orders(spark, folder), "profile").report
    return column_asked(report, "Qual a média de Amount BR?").select("column", *_STATS)


@query(f"with d as ({D}) select cast(count(*) as bigint) as rows_evaluated, cast({len(DIRTY_COLUMNS)} as integer) "
       "as columns from d")
def row_and_column_count(spark: SparkSession, folder: str) -> DataFrame:
    return table_size(clean(dirty_orders(spark, folder), "profile").report)


@query(f"""with d as ({D}) select cast(sum(n - 1) as bigint) as duplicates, cast(sum(n - 1) as bigint) as removed
           from (select count(*) as n from d group by {CELLS}) g""")
def duplicates_answer(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates_found(clean(dirty_orders(spark, folder), "dedup").report)


def flat_report(report: DataFrame) -> DataFrame:
    return report.select(
        "operation", "rows_read", "rows_exported", "rows_evaluated", "empty_rows_found",
        F.col("changes.empty_rows").alias("empty_rows_removed"), "duplicates", "changes.duplicates_removed",
        "changes.trimmed", "changes.formula_guarded", "changes.punctuation", "ignored_conversions", "invalid_dates",
        "values_changed")


TIDY_REPORT = Q.report_sql("tidy", trim=True, drop_empty=True, guard_cells=True)


@query(TIDY_REPORT)
def run_report(spark: SparkSession, folder: str) -> DataFrame:
    return flat_report(clean(dirty_orders(spark, folder), "tidy").report)


@query(f"""select rows_read, empty_rows_found, rows_evaluated, rows_exported, trimmed, formula_guarded, punctuation,
    ignored_conversions, cast(0 as bigint) as irregular_rows from ({TIDY_REPORT}) r""")
def observed_run(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of a run as they come with its write."""
    counters = write_result(clean(dirty_orders(spark, folder), "tidy"), scratch_folder(spark, "observed"))
    return spark.createDataFrame([counters], ", ".join(f"{name} long" for name in counters))


# Totals beyond any decimal type: keys far to the left, with both signs, and far to the right of the point.
_HUGE = """select concat(cast(o_orderkey as {S}), repeat('0', 38)) as huge,
    concat(case when o_orderkey % 2 = 0 then '-' else '+' end, cast(o_orderkey as {S}), 'e40') as signed,
    concat(cast(cast(o_totalprice as decimal(18,2)) as {S}), 'E-12') as tiny,
    case when o_orderkey % 3 = 0 then 'n/a' else cast(o_custkey as {S}) end as plain from {orders}"""


@query(f"""with h as ({_HUGE.replace('{S}', 'varchar').replace('{orders}', 'orders')}), t as (
    select 0 as position, 'huge' as "column", count(*) filter (o_orderkey <> 0) as numeric, cast(sum(o_orderkey) as varchar) || repeat('0', 38) as total from orders
    union all select 1, 'signed', count(*), cast(sum(case when o_orderkey % 2 = 0 then -o_orderkey else o_orderkey end) as varchar)
      || repeat('0', 40) from orders
    union all select 2, 'tiny', count(*), cast(sum(cents) // 100000000000000 as varchar) || '.'
      || rtrim(lpad(cast(sum(cents) % 100000000000000 as varchar), 14, '0'), '0')
      from (select cast(cast(o_totalprice as decimal(18,2)) * 100 as hugeint) as cents from orders)
    union all select 3, 'plain', count(*) filter (plain <> 'n/a'), cast(sum(try_cast(plain as bigint)) as varchar) from h)
    select "column", position, cast(numeric as bigint) as numeric, total from t""")
def profile_huge_totals(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders")
    return exact_totals(spark.sql(_HUGE.replace("{S}", "string"), orders=orders))


@query(f"select rows_read, rows_exported, empty_rows_removed, duplicates_removed, true as reconciled "
       f"from ({Q.report_sql('tidy', trim=True, drop_empty=True, dedup=True, guard_cells=True)}) r")
def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    report = clean(dirty_orders(spark, folder), "tidy", deduplicate=True).report
    checked = reconciled(report)
    return checked.select("rows_read", "rows_exported", F.col("changes.empty_rows").alias("empty_rows_removed"),
                          "changes.duplicates_removed", "reconciled")


_REPORTS = [
    ("headers", {}, {}), ("trim", {}, {"trim": True}), ("drop_empty", {}, {"drop_empty": True}),
    ("dedup", {}, {"dedup": True}), ("delimiter", {"delimiter": ";"}, {}),
    ("punctuation", {"column": "amount_br", "direction": "br_to_us"}, {"convert": ("amount_br", "br_to_us")}),
    ("profile", {}, {"writes": False}), ("missing", {}, {"writes": False}), ("duplicates", {}, {"writes": False}),
]


@query(" union all ".join(f"({Q.report_sql(name, **rules)})" for name, _, rules in _REPORTS))
def operation_reports(spark: SparkSession, folder: str) -> DataFrame:
    d = dirty_orders(spark, folder)
    reports = [flat_report(clean(d, name, **options).report) for name, options, _ in _REPORTS]
    return reduce(DataFrame.unionByName, reports)


MESSY_HEADERS = [" ID ", "Prioridade", "Valor", "Valor", "Data de Emissão"]
_CLEAN_HEADERS = ["id", "prioridade", "valor", "valor_2", "data_de_emissao"]


@query(f"""with d as ({D}), {Q.cells_cte('d', DIRTY_COLUMNS)}, m as (select * from (values
    {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(zip(MESSY_HEADERS, _CLEAN_HEADERS)))}) v(p, source, target))
    select cast(p as integer) as position, source, target, source <> target as changed,
           cast(count(*) filter (k = 'missing') as bigint) as missing
    from m join cells on cells.position = m.p group by all""")
def header_map(spark: SparkSession, folder: str) -> DataFrame:
    messy = as_table(dirty_orders(spark, folder).toDF(*MESSY_HEADERS))
    result = clean(messy, "headers")
    pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for _, s, t in result.header_map])
    listed = result.report.select(F.posexplode(pairs).alias("position", "pair"), F.col("profile").alias("columns"))
    return listed.select(
        "position", "pair.source", "pair.target", (F.col("pair.source") != F.col("pair.target")).alias("changed"),
        F.element_at("columns", F.col("position") + 1)["missing"].alias("missing"))
