"""Queries for readers and writers. Those that need files write them from the tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveframe.catalog.base import DIRTY_COLUMNS, D, dirty_orders, load, query
from sieveframe.catalog.cleaning import GUARDED, WITH_D
from sieveframe.functions import cells as C
from sieveframe.plans.clean import clean
from sieveframe.session import scratch_folder
from sieveframe.sinks.layout import part_layout as layout_of, place_lines, write_result_in_order
from sieveframe.sinks.parts import LINE_END, assign_parts, csv_field, header_line, part_files, write_parts, write_result
from sieveframe.sources.files import manifest, probe_files
from sieveframe.sources.fragments import stack_fragments
from sieveframe.sources.payloads import json_rows as rows_of_json
from sieveframe.sources.sheets import sheet_table, sheet_union as union_of_sheets
from sieveframe.sources.tables import irregular, read_table, table_of_fields, widen

PART_BYTES = 64 * 1024


def _round_trip(spark: SparkSession, folder: str, sep: str, fmt: str) -> DataFrame:
    path = scratch_folder(spark, fmt)
    write_parts(dirty_orders(spark, folder), path, PART_BYTES, sep)
    table = read_table(spark, path, fmt)
    return clean(table, "tidy").data


@query(WITH_D + GUARDED)
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, ";", "csv")


@query(WITH_D + GUARDED)
def tsv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, "\t", "tsv")


@query("select conv_id, turn, role, text from conversations")
def multiline_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "multiline")
    write_parts(C.stringify(load(spark, folder, "conversations")), path, PART_BYTES, ",")
    data = read_table(spark, path, "csv").data
    return data.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       "role", "text")


def _headed_files(lines: DataFrame, header: str, order: list[str], purpose: str) -> str:
    """Files of lines, in order from file to file, each under the header."""
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    line = F.when(first, F.concat(F.lit(header + "\n"), F.col("line"))).otherwise(F.col("line"))
    path = scratch_folder(lines.sparkSession, purpose)
    lines.orderBy(*order).select(line.alias("line")).write.text(path)
    return path


# Every tenth row is a blank line, some rows hold spaces only, some an empty cell alone.
_BLANKS = """case when o_orderkey % 10 = 0 then '' when o_orderkey % 15 = 1 then '   '
    else concat(cast(o_orderkey as {S}), ';', case when o_orderkey % 4 = 0 then '' else o_orderpriority end) end"""


@query(f"""with l as (select row_number() over (order by o_orderkey) as "row", {_BLANKS.replace('{S}', 'varchar')} as line from orders)
    select "row", case when contains(line, ';') then split_part(line, ';', 1) else line end as id,
    case when contains(line, ';') then split_part(line, ';', 2) else '' end as priority from l""")
def csv_blank_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Blank lines are rows, and stay where they are."""
    lines = load(spark, folder, "orders").select("o_orderkey", F.expr(_BLANKS.replace("{S}", "string")).alias("line"))
    table = read_table(spark, _headed_files(lines, "id;priority", ["o_orderkey"], "blank"), "csv", place=True)
    return table.data.select("row", "id", "priority")


@query("""select row_number() over (order by conv_id, turn) as "row", conv_id::varchar as conv, turn::varchar as turn, role, text,
    cast(len(text) - len(replace(text, chr(10), '')) + 1 as bigint) as "lines" from conversations""")
def csv_row_order(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of several files with line breaks inside cells, by their place; lines count up from record to record."""
    cells = load(spark, folder, "conversations").select("conv_id", "turn", F.concat_ws(
        ",", "conv_id", "turn", csv_field(F.col("role"), ","), csv_field(F.col("text"), ",")).alias("line"))
    table = read_table(spark, _headed_files(cells, "conv,turn,role,text", ["conv_id", "turn"], "order"), "csv", place=True)
    own = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    after = F.lead("line").over(Window.partitionBy("path").orderBy("record"))
    return table.data.select("row", "conv", "turn", "role", "text", F.coalesce(after - F.col("line"), own).cast("bigint").alias("lines"))


# Quotes that are text, and cells with line breaks, delimiters and doubled quotes.
_QUOTES = """case o_orderkey % 5 when 0 then concat(o_orderstatus, '" pipe') when 1 then concat('5" and "', o_orderpriority)
    when 2 then concat('"', o_orderpriority, {NL}, '""a"";b', {NL}, ',x"') when 3 then '""' else o_orderpriority end"""
_QUOTED = """case o_orderkey % 5 when 2 then concat(o_orderpriority, chr(10), '"a";b', chr(10), ',x') when 3 then ''
    when 0 then concat(o_orderstatus, '" pipe') when 1 then concat('5" and "', o_orderpriority) else o_orderpriority end"""


@query(f"""select row_number() over (order by o_orderkey) as "row", o_orderkey::varchar as id, {_QUOTED} as note, 'z"' as tail from orders""")
def csv_literal_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """A quote inside a field that does not begin with one is text; others hold line breaks and delimiters."""
    orders = load(spark, folder, "orders")
    note = F.expr(_QUOTES.replace("{NL}", "chr(10)"))
    lines = orders.select("o_orderkey", F.concat_ws(";", F.col("o_orderkey").cast("string"), note, F.lit('z"')).alias("line"))
    table = read_table(spark, _headed_files(lines, "id;note;tail", ["o_orderkey"], "literal"), "csv", place=True)
    return table.data.select("row", "id", "note", "tail")


_HEADERS = [("|", '"a;b;c;d, e"|total'), (";", "Value, $;Name, short, long"), (",", 'x|y,"p;q;r"'), ("\t", '"one, two, three"\tfour|five')]


@query(f"""select distinct doc_id % 4 as kind, case doc_id % 4 {" ".join(
    f"when {k} then {'chr(9)' if d == chr(9) else repr(d)}" for k, (d, _) in enumerate(_HEADERS))} end as delimiter from documents""")
def csv_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    """Delimiters of files whose headers hold other candidates more often, inside quotes and outside."""
    root = scratch_folder(spark, "delimiters")
    documents = load(spark, folder, "documents")
    for kind, (mark, header) in enumerate(_HEADERS):
        lines = documents.where(F.col("doc_id") % 4 == kind).select("doc_id", F.concat_ws(mark, "doc_id", "source").alias("line"))
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        lines.select(F.when(first, F.concat(F.lit(header + "\n"), F.col("line"))).otherwise(F.col("line")).alias("line")) \
            .write.text(f"{root}/kind={kind}")
    found = probe_files(spark, root).where(F.col("length") > 0)
    return found.select(F.regexp_extract("path", "kind=([0-9])", 1).cast("bigint").alias("kind"), "delimiter").distinct()


_LINE = "concat_ws(',', " + ", ".join(
    f"case when contains({c}, ',') then '\"' || {c} || '\"' else {c} end" for c in DIRTY_COLUMNS) + ")"


@query(f"""with d as ({D}), l as (select {_LINE} as line from d)
           select cast(count(*) as bigint) as "rows", cast(sum(strlen(line) + 2) as bigint) as line_bytes,
                  cast(max(strlen(line) + 2) as bigint) as longest, true as within_limit from l""")
def part_assignment(spark: SparkSession, folder: str) -> DataFrame:
    parts = assign_parts(dirty_orders(spark, folder), PART_BYTES)
    head = len((header_line(DIRTY_COLUMNS, ",") + LINE_END).encode())
    sizes = parts.groupBy("part").agg(F.count("*").alias("rows"), F.sum("line_bytes").alias("bytes"),
                                      F.max("line_bytes").alias("longest"))
    return sizes.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("line_bytes"), F.max("longest").alias("longest"),
                     (F.max("bytes") + head <= PART_BYTES).alias("within_limit"))


# Orders by key; each 500th has a note above half of a part.
_NOTED = "o_orderkey as id, o_orderstatus as status, case when o_orderkey % 500 = 0 then repeat('x', 33000 + cast(o_orderkey % 7 as int)) else o_orderpriority end as note"
_ROOM = PART_BYTES - len((header_line(["id", "status", "note"], ",") + LINE_END).encode())


@query(f"""with n as (select {_NOTED} from orders),
    l as (select id, strlen(concat_ws(',', cast(id as varchar), status, note)) + 2 as size from n),
    s as (select *, size > {_ROOM // 2} as large, case when size > {_ROOM // 2} then 0 else size end as small from l),
    o as (select *, row_number() over w - 1 as row, sum(size) over w - size as place, sum(small) over w - small as start,
                 count(*) filter (large) over w as turn, max(small) over () as largest from s window w as (order by id)),
    k as (select *, case when large then 0 else 1 + cast(floor(start / ({_ROOM} - largest)) as bigint) end as slot from o)
    select dense_rank() over (order by turn, slot) - 1 as part, count(*) as "rows", min(row) as first_row, max(row) as last_row,
           cast(min(place) as bigint) as first_byte, cast(sum(size) as bigint) as bytes from k group by turn, slot""")
def part_layout(spark: SparkSession, folder: str) -> DataFrame:
    noted = spark.sql(f"select {_NOTED} from {{orders}}", orders=load(spark, folder, "orders"))
    return layout_of(place_lines(noted.orderBy("id"), PART_BYTES))


@query(f"""with n as (select {_NOTED} from orders)
    select row_number() over (order by id) as "row", cast(id as varchar) as id, status, length(note) as note_length,
           true as within_limit, (select count(*) from n) as rows_exported from n""")
def ordered_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of parts written in order, read again by their place, with the counters of the run that wrote them."""
    noted = spark.sql(f"select {_NOTED} from {{orders}}", orders=load(spark, folder, "orders"))
    path = scratch_folder(spark, "ordered")
    counters = write_result_in_order(clean(noted.orderBy("id"), "delimiter", delimiter=";"), path, PART_BYTES)
    longest = part_files(spark, path).agg(F.max("bytes").alias("bytes")).first()["bytes"]
    rows = read_table(spark, path, "csv", place=True, ordered=True).data
    return rows.select("row", "id", "status", F.length("note").cast("bigint").alias("note_length"),
                       F.lit(longest <= PART_BYTES).alias("within_limit"),
                       F.lit(counters["rows_exported"]).cast("bigint").alias("rows_exported"))


@query(f"""with d as ({D}), l as (select {_LINE} as line from d)
           select cast(sum(strlen(line) + 2) as bigint) as line_bytes, true as within_limit, true as split from l""")
def written_parts(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "parts")
    write_result(clean(dirty_orders(spark, folder), "delimiter", delimiter=","), path, PART_BYTES)
    head = len((header_line(DIRTY_COLUMNS, ",") + LINE_END).encode())
    return part_files(spark, path).agg(
        (F.sum("bytes") - F.count("*") * head).alias("line_bytes"), (F.max("bytes") <= PART_BYTES).alias("within_limit"),
        (F.count("*") > 1).alias("split"))


_FIELDS_SQL = """case o_orderkey % 5 when 0 then [o_orderkey::varchar, o_orderstatus, o_orderpriority, 'late', 'x']
    when 1 then [o_orderkey::varchar] when 2 then []::varchar[] else [o_orderkey::varchar, o_orderstatus, o_orderpriority] end"""
RAGGED_HEADERS = ["Order", "Status", "Status"]


def _ragged(spark: SparkSession, folder: str) -> DataFrame:
    key, case = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    full = F.array(key, F.col("o_orderstatus"), F.col("o_orderpriority"))
    fields = (F.when(case == 0, F.concat(full, F.array(F.lit("late"), F.lit("x")))).when(case == 1, F.array(key))
              .when(case == 2, F.array().cast("array<string>")).otherwise(full))
    return load(spark, folder, "orders").select("o_orderkey", fields.alias("fields"))


_WIDE = ", ".join(f"coalesce(f[{i}], '') as {n}" for i, n in enumerate(
    ["\"order\"", "status", "status_2", "extra_1", "extra_2"], 1))


@query(f"with r as (select {_FIELDS_SQL} as f from orders) select {_WIDE} from r")
def ragged_widen(spark: SparkSession, folder: str) -> DataFrame:
    return widen(_ragged(spark, folder), "fields", RAGGED_HEADERS)


@query(f"with r as (select o_orderkey, {_FIELDS_SQL} as f from orders) "
       "select o_orderkey, cast(len(f) as integer) as width from r where len(f) <> 3")
def irregular_rows(spark: SparkSession, folder: str) -> DataFrame:
    return irregular(_ragged(spark, folder), "fields", len(RAGGED_HEADERS)).select(
        "o_orderkey", F.size("fields").alias("width"))


@query(f"""with r as (select {_FIELDS_SQL} as f from orders) select cast(count(*) as bigint) as rows_read,
    cast(count(*) filter (len(f) = 0) as bigint) as empty_rows_found,
    cast(count(*) filter (len(f) > 0) as bigint) as rows_exported,
    cast(count(*) filter (len(f) > 0 and len(f) <> 3) as bigint) as irregular_rows from r""")
def ragged_report(spark: SparkSession, folder: str) -> DataFrame:
    table = table_of_fields(_ragged(spark, folder), "fields", RAGGED_HEADERS)
    return clean(table, "tidy").report.select("rows_read", "empty_rows_found", "rows_exported", "irregular_rows")


@query(f"with r as (select {_FIELDS_SQL} as f from orders) select {_WIDE}, cast(len(f) as integer) as width from r")
def ragged_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "ragged")
    lines = _ragged(spark, folder).select(F.concat_ws(";", "fields").alias("line"))
    # Every written file opens with the header, as the files of one table do.
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    headed = lines.select(F.when(first, F.concat(F.lit(";".join(RAGGED_HEADERS) + "\n"), F.col("line")))
                          .otherwise(F.col("line")).alias("line"))
    headed.write.text(path)
    table = read_table(spark, path, "csv")
    return table.data.withColumnRenamed(table.width_column, "width")


_CUSTOMER = "c_custkey::varchar as key, c_name as name, c_acctbal::varchar as balance, c_mktsegment as segment"
_SUPPLIER = "s_suppkey::varchar as key, s_name as name, s_acctbal::varchar as balance, '' as segment"


@query(f"""select {_CUSTOMER}, '' as code, 'Customers' as _sheet from customer where c_custkey % 10 > 0
    union all select '', '', '', '', '', '' from customer where c_custkey % 10 = 0
    union all select {_SUPPLIER}, s_nationkey::varchar as code, 'Suppliers' from supplier""")
def sheet_union(spark: SparkSession, folder: str) -> DataFrame:
    return union_of_sheets(_sheets(spark, folder))


def _sheets(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    customer, supplier = load(spark, folder, "customer"), load(spark, folder, "supplier")
    tenth = F.col("c_custkey") % 10 == 0
    customers = customer.select(*[F.when(~tenth, F.col(source)).alias(name) for source, name in (
        ("c_custkey", "Key"), ("c_name", "Name"), ("c_acctbal", "Balance"), ("c_mktsegment", "Segment"))])
    suppliers = supplier.select(F.col("s_suppkey").alias("KEY"), F.col("s_nationkey").alias("Code"),
                                F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return {"Customers": customers, "Suppliers": suppliers}


@query("""select cast((select count(*) from customer) + (select count(*) from supplier) as bigint) as rows_read,
    cast((select count(*) from customer where c_custkey % 10 = 0) as bigint) as empty_rows_found,
    cast((select count(*) from customer where c_custkey % 10 = 0) as bigint) as irregular_rows""")
def sheet_report(spark: SparkSession, folder: str) -> DataFrame:
    return clean(sheet_table(_sheets(spark, folder)), "trim").report.select(
        "rows_read", "empty_rows_found", "irregular_rows")


# Customers as documents: a page per market segment, a table per nation, one order a row. Customers
# of nation 3 change their header half-way; customers of nation 5 have a page without tables.
_FRAGMENTS_SQL = """
    o as (select c_nationkey as doc, o_custkey as page, cast(o_orderstatus = 'O' as integer) as table_no, o_orderkey,
                 o_orderpriority from orders join customer on o_custkey = c_custkey),
    f as (select doc, page, table_no, o_orderkey + 1 as row_no, [o_orderkey::varchar, o_orderpriority] as cells from o
          union all select distinct doc, page, table_no, 0,
                 case when doc = 3 and page % 2 = 0 then ['Order', 'Level'] else [' Order', 'Prio' || chr(10) || 'rity'] end from o
          union all select c_nationkey, -c_custkey, null, null, null from customer where c_nationkey = 5
          union all select c_nationkey, -c_custkey, 9, 0, ['lonely'] from customer where c_nationkey = 6)"""


def _fragments(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(
        "with " + _FRAGMENTS_SQL.replace("::varchar", "::string").replace("['", "array('").replace("']", "')")
        .replace("rity'] end", "rity') end").replace("[' Order'", "array(' Order'")
        .replace("[o_orderkey::string, o_orderpriority]", "array(o_orderkey::string, o_orderpriority)")
        .replace("from orders", "from {orders}").replace("join customer", "join {customer}")
        .replace("from customer", "from {customer}") + " select * from f",
        orders=load(spark, folder, "orders"), customer=load(spark, folder, "customer"))


_STACK_SQL = f"""with {_FRAGMENTS_SQL},
    p as (select doc, page, table_no, max(case when row_no = 0 then
            list_transform(cells, lambda c: trim(replace(c, chr(10), ' '))) end) as header
          from f where table_no is not null group by doc, page, table_no having count(*) >= 2),
    h as (select doc, count(*) as fragments, count(distinct header) as headers from p group by doc),
    g as (select doc, count(distinct page) as pages, count(distinct page) filter (rows = 0) as bare
          from (select doc, page, count(table_no) as rows from f group by doc, page) x group by doc)"""


@query(_STACK_SQL + """ select f.doc, f.page, f.table_no, f.row_no, array_to_string(p.header, '|') as header,
    array_to_string(f.cells, '|') as cells from f join p using (doc, page, table_no) join h on h.doc = f.doc and h.headers = 1
    where f.row_no > 0""")
def fragment_stack(spark: SparkSession, folder: str) -> DataFrame:
    rows = stack_fragments(_fragments(spark, folder)).rows
    return rows.select("doc", "page", "table_no", "row_no", F.array_join("header", "|").alias("header"),
                       F.array_join("cells", "|").alias("cells"))


@query(_STACK_SQL + """ select g.doc, cast(coalesce(h.fragments, 0) as bigint) as fragments, cast(g.pages as bigint) as pages,
    cast(g.bare as bigint) as pages_without_tables, coalesce(h.headers = 1, false) as accepted from g left join h using (doc)""")
def fragment_documents(spark: SparkSession, folder: str) -> DataFrame:
    return stack_fragments(_fragments(spark, folder)).documents.drop("header")


_PAYLOAD_SQL = """case event_id % 7 when 0 then '{"rows": [1]}' when 1 then '{"rows": {"k": 1}}' when 2 then 'no json'
    when 3 then '{"rows": []}' else '{"rows": [' || props || ', {"kind": "' || event_type || '", "k": null}]}' end"""


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").select("event_id", F.expr(_PAYLOAD_SQL).alias("payload"))


@query("""with e as (select *, event_id % 7 as c from events)
    select coalesce(regexp_extract(props, '"k": *([0-9]+)', 1), '') as k, '' as kind from e where c > 3
    union all select '', event_type from e where c > 3""")
def json_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of_json(_payloads(spark, folder), "payload", ["event_id"])[0]


_CELLS_SQL = """concat('{"rows":[{"k":1,"list":[1, true,null,"a, b:c"],"k":', cast(event_id as {S}), ',"big":1e400,"o":{"x":"', event_type,
    '","y":[]},"t":true,"quoted":"[1,2]","word":"true"}]}')"""


@query("""select event_id::varchar as k, '[1, true, null, "a, b:c"]' as list, 'inf' as big, '{"x": "' || event_type || '", "y": []}' as o,
    'True' as t, '[1,2]' as quoted, 'true' as word from events""")
def json_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Values by their types: the last of a repeated key, lists and objects with spaces, numbers beyond a double."""
    payloads = load(spark, folder, "events").select("event_id", F.expr(_CELLS_SQL.replace("{S}", "string")).alias("payload"))
    return rows_of_json(payloads, "payload", ["event_id"])[0]


@query(f"select event_id, {_PAYLOAD_SQL} as payload from events where event_id % 7 < 3")
def json_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return rows_of_json(_payloads(spark, folder), "payload", ["event_id"])[1]


_CHARSETS = {"fr": "ISO-8859-1", "de": "UTF-16"}


@query("""select distinct lang, case lang when 'fr' then 'cp1252' when 'de' then 'utf-16' else 'utf-8-sig' end as encoding,
    case lang when 'fr' then ';' when 'de' then '|' else ',' end as delimiter, true as filled from documents""")
def file_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written per language in different encodings and delimiters, then found out again."""
    root = scratch_folder(spark, "probe")
    documents = load(spark, folder, "documents").select("doc_id", "source", "text", "lang")
    for lang, encoding, sep in (("fr", "ISO-8859-1", ";"), ("de", "UTF-16", "|")):
        # An accent in the header, so that no file is plain ASCII by chance.
        documents.filter(F.col("lang") == lang).withColumnRenamed("text", "texté").write.option("encoding", encoding).csv(
            f"{root}/lang={lang}", sep=sep, header=True, escape='"')
    rest = documents.filter(~F.col("lang").isin(*_CHARSETS))
    rest.write.partitionBy("lang").csv(f"{root}/rest", header=True, escape='"')
    found = probe_files(spark, f"{root}").filter(F.col("path").rlike(r"\.csv$"))
    return found.groupBy(F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang"), "encoding", "delimiter").agg(
        (F.min("length") > 0).alias("filled"))


@query()
def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(spark, f"{folder}/*.parquet").select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", "sha256")
