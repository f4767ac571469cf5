"""Filter, map and key extraction on arrays and JSON values.

Predicates and expressions are Spark SQL strings over the variable ``item``,
for instance ``item.role = 'user'`` or, on JSON, ``item:price::double > 3``.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.jsontext import ARRAY, NULL, OBJECT, is_array, kind, member, object_text, quote


def items_filter(df: DataFrame, array_col: str, predicate: str) -> DataFrame:
    """Keep the array items for which the predicate holds."""
    return df.withColumn(array_col, F.expr(f"filter(`{array_col}`, item -> {predicate})"))


def items_map(df: DataFrame, array_col: str, expression: str) -> DataFrame:
    """Replace every array item by the expression's value."""
    return df.withColumn(array_col, F.expr(f"transform(`{array_col}`, item -> {expression})"))


def keys_json(value: Column, keys: list[str]) -> Column:
    """JSON text with the listed members that are present, nulls included.

    Of an array the items with the listed index numbers, and ``length``.
    """
    fragments = []
    for key in keys:
        found = F.to_json(member(value, key))
        if key.isdecimal() and str(int(key)) == key:
            found = F.coalesce(found, F.to_json(F.try_variant_get(value, f"$[{key}]", "variant")))
        if key == "length":
            size = F.size(F.try_variant_get(value, "$", "array<variant>")).cast("string")
            found = F.coalesce(found, F.when(is_array(value), size))
        fragments.append(F.concat(quote(F.lit(key)), F.lit(":"), found))
    return object_text(fragments)


def extract_keys(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """Reduce a VARIANT column to the listed members.

    Strings, numbers and booleans stay as they are; JSON null has no members to
    take and gives NULL.
    """
    value = F.col(json_col)
    reduced = F.parse_json(keys_json(value, keys))
    type_name = kind(value)
    return df.withColumn(
        json_col, F.when(type_name.isin(OBJECT, ARRAY), reduced).when(type_name != NULL, value)
    )


def apply_transform(df: DataFrame, json_col: str, spec: dict[str, Any] | None) -> DataFrame:
    """Apply the first of ``filter``, ``map`` and ``extract`` that fits the value.

    ``filter`` and ``map`` fit arrays only; where the first of them is given and
    the value is no array, ``extract`` gets its turn.
    """
    spec = spec or {}
    over_items = next((name for name in ("filter", "map") if spec.get(name)), None)
    keys = spec.get("extract")
    if over_items is None:
        return extract_keys(df, json_col, keys) if keys is not None else df
    work = "_items"
    change = items_filter if over_items == "filter" else items_map
    # JSON items of an array, NULL for any other value
    items = F.when(kind(F.col(json_col)) == ARRAY, F.try_variant_get(json_col, "$", "array<variant>"))
    changed = change(df.withColumn(work, items), work, spec[over_items])
    rest = extract_keys(changed, json_col, keys) if keys is not None else changed
    result = F.when(F.col(work).isNotNull(), F.col(work).cast("variant")).otherwise(F.col(json_col))
    return rest.withColumn(json_col, result).drop(work)
