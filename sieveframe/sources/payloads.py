"""JSON payloads of the form ``{"rows": [object, …]}`` as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveframe.functions.cells import column
from sieveframe.functions.names import MAX_COLUMNS, check_width

ROWS = "rows array<map<string,string>>"


def json_keys(rows: DataFrame, order: Sequence[str]) -> list[str]:
    """The keys of the objects, in the order in which they first appear.

    Only names reach the driver, at most one more than the limit on columns.
    """
    # Objects of the same shape are folded first; only the distinct shapes are taken apart.
    place = F.struct(*[column(c) for c in order], F.col("item"))
    shapes = rows.groupBy(F.array_distinct(F.map_keys("record")).alias("keys")).agg(F.min(place).alias("place"))
    seen = shapes.select("place", F.posexplode("keys").alias("at", "key"))
    found = (seen.groupBy("key").agg(F.min(F.struct("place", "at")).alias("first"))
             .orderBy("first").limit(MAX_COLUMNS + 1).collect())
    return check_width([row["key"] for row in found])


def json_rows(df: DataFrame, payload: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the accepted payloads, one column per key, and the input rows of the rejected ones.

    ``order`` names the columns that put the payloads in sequence. A payload is accepted only if it
    is an object whose ``rows`` is a list of nothing but objects. Of a repeated key the last value counts.
    """
    conf, setting = df.sparkSession.conf, "spark.sql.variant.allowDuplicateKeys"
    before = conf.get(setting)
    conf.set(setting, "true")  # read when an expression is planned
    try:
        return _json_rows(df, payload, order)
    finally:
        conf.set(setting, before)


def _json_rows(df: DataFrame, payload: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    text = F.col(payload)
    items = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$.rows", "array<variant>"), F.lit(None))
    kinds = F.transform("_items", lambda item: F.schema_of_variant(item))
    objects = F.col("_items").isNotNull() & F.forall(kinds, lambda kind: kind.startswith("OBJECT"))
    marked = df.withColumn("_items", items).withColumn("_accepted", F.coalesce(objects, F.lit(False)))
    bad = marked.filter("NOT _accepted").drop("_accepted", "_items")
    # A filter on what is parsed would move below and parse again; rejected payloads leave by having no item.
    parsed = F.when(F.col("_accepted"), F.from_json(text, ROWS)["rows"])
    records = marked.select(*[column(c) for c in order], "_items", F.posexplode_outer(parsed).alias("item", "record")) \
        .where("item IS NOT NULL")
    keys = json_keys(records, order)
    # Each step is worked out once, as columns of its own: the object, its values, and then their texts.
    taken = records.select(F.get("_items", F.col("item")).alias("_object"), F.reverse(F.map_keys("record")).alias("_keys"),
                           F.reverse(F.map_values("record")).alias("_values"))
    values = taken.select("_object", *[_last_value(key).alias(f"_v{i}") for i, key in enumerate(keys)])
    return values.select(*[_cell(F.col(f"_v{i}"), key).alias(key) for i, key in enumerate(keys)]), bad


def _last_value(key: str) -> Column:
    """A key's last value, from keys and values that are turned round; NULL without the key."""
    return F.get("_values", F.array_position("_keys", key).cast("int") - 1)


def _spaced(text: Column) -> Column:
    """Compact JSON with a space after each comma and colon outside strings."""
    return F.rtrim(F.regexp_replace(text, r'((?:"(?:[^"\\]++|\\.)*+"|[^",:]++)*+)([,:]|\z)', "$1$2 "))


def _cell(value: Column, key: str) -> Column:
    """Text of a key's value, by the type it has in ``_object``: truth values, lists and objects, infinite numbers."""
    if "'" in key or "\\" in key:  # no path names such a key
        return F.coalesce(value, F.lit(""))
    kind = F.schema_of_variant(F.try_variant_get("_object", f"$['{key}']", "variant"))
    typed = (F.when(value.isin("true", "false"), F.when(kind == "BOOLEAN", F.initcap(value)))
             .when(value.rlike(r"^[\[{]"), F.when(kind.rlike("^(ARRAY|OBJECT)"), _spaced(value)))
             .when(value.isin('"Infinity"', '"-Infinity"'), F.when(kind == "DOUBLE", F.regexp_replace(value, '"(-?).*"', "$1inf"))))
    return F.coalesce(typed, value, F.lit(""))
