"""Registry of the queries over the provided tables, each with its ANSI SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its own name."""
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


DIRTY_COLUMNS = ["id", "priority", "amount", "amount_br", "odate"]

# The provided orders with defects put in by rule: padding, blank rows, formulas, signs, two number
# formats, impossible dates and copies. The same text runs on both engines.
_DIRTY = """
with b as (
  select o_orderkey k, lpad(cast(o_orderkey as {S}), 6, '0') id, o_orderpriority pr, o_orderstatus st,
         cast(cast(o_totalprice as decimal(18,2)) as {S}) s, substr(cast(o_orderdate as {S}), 1, 10) d
  from {orders}),
c as (
  select k,
    case when k % 97 = 0 then '' else id end as id,
    case when k % 97 = 0 then '  ' when k % 7 = 0 then concat(' ', pr, '  ') else pr end as priority,
    case when k % 97 = 0 or k % 11 = 0 then '' when k % 13 = 0 then concat('=', st, '+1')
         when k % 17 = 0 then concat('-', s) when k % 19 = 0 then replace(s, '.', ',') else s end as amount,
    case when k % 97 = 0 then '' when k % 23 = 0 then concat('0', s)
         when length(s) > 6 then concat(substr(s, 1, length(s) - 6), '{T}', substr(s, length(s) - 5, 3), '{M}',
                                        substr(s, length(s) - 1, 2))
         else replace(s, '.', '{M}') end as amount_br,
    case when k % 97 = 0 then '' when k % 50 = 0 then '2025-02-30' when k % 29 = 0 then concat(d, 'T10:11')
         when k % 31 = 0 then 'n/a' else d end as odate
  from b)
select id, priority, amount, amount_br, odate from c
union all
select id, priority, amount, amount_br, odate from c where k % 20 = 0
"""


def _dirty_sql(string: str, orders: str, thousands: str, mark: str) -> str:
    return (_DIRTY.replace("{S}", string).replace("{T}", thousands).replace("{M}", mark)
            .replace("{orders}", orders))


def dirty_orders(spark: SparkSession, folder: str, thousands: str = ".", mark: str = ",") -> DataFrame:
    return spark.sql(_dirty_sql("string", "{orders}", thousands, mark), orders=load(spark, folder, "orders"))


def dirty_sql(thousands: str = ".", mark: str = ",") -> str:
    """The same relation for the oracle, to be used as ``with d as (…)``."""
    return _dirty_sql("varchar", "orders", thousands, mark)


D = dirty_sql()
