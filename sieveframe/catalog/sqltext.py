"""SQL fragments of the oracles. They state the rules independently of the Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from sieveframe.catalog.base import DIRTY_COLUMNS, dirty_sql

BLANKS = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def strip(v: str) -> str:
    return f"regexp_replace({v}, '^{BLANKS}+|{BLANKS}+\\z', '', 'g')"


def blank(v: str) -> str:
    return f"regexp_full_match({v}, '{BLANKS}*')"


def number(v: str) -> str:
    return (f"(regexp_full_match({v}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') and length({v}) < 100 "
            f"and (try_cast({v} as double) = 0 or (abs(try_cast({v} as double)) >= 1e-100 "
            f"and abs(try_cast({v} as double)) < 1e101)))")


def exact(v: str) -> str:
    return (f"case when regexp_full_match({v}, '[+-]?([0-9]{{1,18}}(\\.[0-9]{{0,10}})?|\\.[0-9]{{1,10}})') "
            f"then try_cast({v} as decimal(28,10)) end")


def comma_number(v: str) -> str:
    return f"regexp_full_match({v}, '[+-]?[0-9]+,[0-9]+')"


def iso_like(v: str) -> str:
    return f"regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][^\\n]*)?')"


def _iso_time() -> str:
    part = "([.,][0-9]+)?"
    hour, sixty = "([01][0-9]|2[0-3])", "[0-5][0-9]"
    clock = f"{hour}({part}|:{sixty}({part}|:{sixty}{part})|{sixty}({part}|{sixty}{part}))"
    zone = clock.replace(sixty, "[0-9]{2}")
    return f"{clock}(Z|[+-]{zone})?"


def iso_valid(v: str) -> str:
    return (f"({iso_like(v)} and try_cast(substr({v}, 1, 10) as date) is not null and substr({v}, 1, 4) <> '0000' "
            f"and (length({v}) = 10 or regexp_full_match(substr({v}, 12), '{_iso_time()}')))")


def cell_class(v: str) -> str:
    return (f"case when {v} = '' then 'missing' when regexp_matches({v}, '^[+-]?0[0-9]') then 'possible_identifier' "
            f"when {number(v)} then 'number' when {iso_like(v)} then case when {iso_valid(v)} then 'iso_date' "
            f"else 'invalid_date' end else 'text' end")


def needs_guard(v: str) -> str:
    return (f"(substr({v}, 1, 1) in ('=', '@', '+', '-') and not {comma_number(v)} "
            f"and not regexp_full_match({v}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?'))")


def guard(v: str) -> str:
    return f"case when {needs_guard(v)} then '''' || {v} else {v} end"


def _grammar(mark: str, thousands: str) -> str:
    return (f"[+-]?(0|[1-9][0-9]*|[1-9][0-9]{{0,2}}({thousands}[0-9]{{3}})+)({mark}[0-9]+)?")


def converts(v: str, direction: str) -> str:
    mark, thousands = (",", r"\.") if direction == "br_to_us" else (r"\.", ",")
    return f"regexp_full_match({v}, '{_grammar(mark, thousands)}')"


def converted(v: str, direction: str) -> str:
    mark, thousands = (",", ".") if direction == "br_to_us" else (".", ",")
    return (f"case when {converts(v, direction)} "
            f"then replace(replace({v}, '{thousands}', ''), '{mark}', '{thousands}') else {v} end")


def select_cells(expression, columns: Sequence[str] = DIRTY_COLUMNS) -> str:
    return ", ".join(f"{expression(c)} as {c}" for c in columns)


def all_blank(columns: Sequence[str] = DIRTY_COLUMNS) -> str:
    return "(" + " and ".join(blank(c) for c in columns) + ")"


def float_text(v: str) -> str:
    return f"coalesce(cast({v} as varchar), '')"


def moment_text(v: str) -> str:
    return (f"case when {v} is null then '' when microsecond({v}) % 1000000 = 0 then strftime({v}, '%Y-%m-%dT%H:%M:%S') "
            f"else strftime({v}, '%Y-%m-%dT%H:%M:%S.%f') end")


PROFILE_FIELDS = """
    cast(count(*) filter (k = 'missing') as bigint) as missing,
    cast(count(*) filter (k = 'possible_identifier') as bigint) as leading_zero,
    cast(count(*) filter (k = 'number') as bigint) as numeric_cells,
    cast(count(*) filter (k = 'number' and n is null) as bigint) as number_inexact,
    cast(count(*) filter (k = 'iso_date') as bigint) as iso_date,
    cast(count(*) filter (k = 'invalid_date') as bigint) as invalid_date,
    cast(count(*) filter (k = 'text') as bigint) as text_cells,
    cast(count(*) filter (k = 'number' and regexp_matches(v, '^-[0-9.]*[1-9]')) as bigint) as negative,
    cast(count(*) filter (k = 'text' and {comma}) as bigint) as comma_number,
    min(case when k = 'number' then a end) as min_num,
    max(case when k = 'number' then a end) as max_num,
    sum(case when k = 'number' then a end) as sum_num,
    round(cast(sum(case when k = 'number' then a end) as double) / nullif(count(*) filter (k = 'number'), 0), 6) as mean_num,
    count(*) filter (k = 'number') > 0 and count(*) filter (k = 'text') > 0 as mixed_type
""".replace("{comma}", comma_number("v"))


def cells_cte(relation: str, columns: Sequence[str]) -> str:
    """``cells(column_name, position, v, k, n, a)``: every cell of ``relation`` with its class."""
    names = ", ".join(f"'{c}'" for c in columns)
    positions = ", ".join(str(i) for i in range(len(columns)))
    values = ", ".join(f'"{c}"' for c in columns)
    return (f"raw_cells as (select unnest([{names}]) as column_name, unnest([{positions}]) as position, "
            f"unnest([{values}]) as r from {relation}), "
            f"shown as (select column_name, position, case when {blank('r')} then '' else r end as v from raw_cells), "
            f"cells as (select *, {cell_class('v')} as k, {exact('v')} as n, "
            "try_cast(v as decimal(38,10)) as a from shown)")


def profile_sql(ctes: str, relation: str, columns: Sequence[str]) -> str:
    return (f"with {ctes}, {cells_cte(relation, columns)} "
            f"select column_name as \"column\", cast(position as integer) as position, {PROFILE_FIELDS} "
            f"from cells group by column_name, position")


def report_sql(operation: str, trim: bool = False, drop_empty: bool = False, dedup: bool = False,
               guard_cells: bool = False, convert: tuple[str, str] | None = None, writes: bool = True,
               relation: str | None = None, columns: Sequence[str] = DIRTY_COLUMNS) -> str:
    """Counters of one operation on the dirty orders, computed row by row and then copy by copy."""
    def value(c: str) -> str:
        cell = strip(c) if trim else c
        return converted(cell, convert[1]) if convert and c == convert[0] else cell

    trimmed = " + ".join(f"cast({strip(c)} <> {c} as integer)" for c in columns) if trim else "0"
    if convert:
        target = strip(convert[0]) if trim else convert[0]
        changed = f"cast({converted(target, convert[1])} <> {target} as integer)"
        ignored = f"cast({target} <> '' and not {converts(target, convert[1])} as integer)"
    else:
        changed = ignored = "0"
    keep = f"not {all_blank(columns)}" if drop_empty else "true"
    guards = " + ".join(f"cast({needs_guard(c)} as integer)" for c in columns) if guard_cells else "0"
    copies = "1" if dedup else "n"
    cells = ", ".join(columns)
    total = "coalesce(cast(sum({0}) as bigint), 0)".format
    invalid = " + ".join(f"cast({cell_class(c)} = 'invalid_date' as integer)" for c in columns)
    return f"""
select '{operation}' as operation, rows_read, {'rows_evaluated' if writes else 'cast(0 as bigint)'} as rows_exported,
       rows_evaluated, empty_rows_found, {'empty_rows_found' if drop_empty else 'cast(0 as bigint)'} as empty_rows_removed,
       duplicates, {'duplicates' if dedup else 'cast(0 as bigint)'} as duplicates_removed, trimmed, formula_guarded,
       punctuation, ignored_conversions, invalid_dates, trimmed + formula_guarded + punctuation as values_changed
from (
  select (select cast(count(*) as bigint) from ({relation or dirty_sql()}) x) as rows_read,
         (select cast(count(*) as bigint) from ({relation or dirty_sql()}) x where {all_blank(columns)}) as empty_rows_found,
         {total(copies)} as rows_evaluated, {total('n - 1')} as duplicates, {total('trimmed')} as trimmed,
         {total(f'{copies} * ({guards})')} as formula_guarded, {total('changed')} as punctuation,
         {total('ignored')} as ignored_conversions, {total(f'{copies} * ({invalid})')} as invalid_dates
  from (
    select {cells}, count(*) as n, sum(trimmed) as trimmed, sum(changed) as changed, sum(ignored) as ignored
    from (select {select_cells(value, columns)}, {trimmed} as trimmed, {changed} as changed, {ignored} as ignored
          from ({relation or dirty_sql()}) x) y
    where {keep} group by {cells}) z)
"""
