"""Declarative field rules, compiled to one projection.

A rule set maps an output name to ``{"source", "transform", "factor",
"default"}``. Transforms are ``uppercase``, ``lowercase``, ``multiply`` and
``round``; with any other, or none, the value passes through.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.binding import once
from corpuscope.functions.jsontext import member, object_text, quote, value_json, value_number, value_text
from corpuscope.functions.numbers import finite_text, number_text, round_half_up, to_number

Rules = dict[str, dict[str, Any]]

_COMPACT = {"ensure_ascii": False, "separators": (",", ":")}


def apply_rules(df: DataFrame, rules: Rules, keep: tuple[str, ...] = ()) -> DataFrame:
    """New record per row, from typed columns.

    A column that is missing or NULL counts as absent. Without rules the input
    comes back; fields without a rule are dropped, but for those named in ``keep``.
    """
    if not rules:
        return df
    types = dict(df.dtypes)
    columns = []
    for name, rule in rules.items():
        source = rule.get("source")
        if source in types:
            column = F.col(f"`{source}`")
            value, type_name = _typed(column, types[source], rule)
            if "default" in rule:
                value = _filled(column.isNotNull(), value, type_name, rule["default"])
            columns.append(value.alias(name))
        elif "default" in rule:
            columns.append(_constant(rule["default"]).alias(name))
    return df.select(*keep, *columns)


def _typed(value: Column, type_name: str, rule: dict[str, Any]) -> tuple[Column, str]:
    """The transformed value and its type."""
    transform = rule.get("transform")
    if transform in ("uppercase", "lowercase"):
        text = _text(value, type_name)
        return (F.upper(text) if transform == "uppercase" else F.lower(text)), "string"
    if transform == "multiply":
        return typed_number(value, type_name) * F.lit(float(rule.get("factor") or 1)), "double"
    if transform == "round":
        return round_half_up(typed_number(value, type_name)), "double"
    return value, type_name


def _text(value: Column, type_name: str) -> Column:
    if type_name == "variant":
        return value_text(value)
    if type_name in ("double", "float"):
        return number_text(value.cast("double"))
    return value.cast("string")


def _constant(default: Any) -> Column:
    """A default as a column; a list or an object becomes VARIANT."""
    if isinstance(default, (dict, list)):
        return F.parse_json(F.lit(json.dumps(default, **_COMPACT)))
    return F.lit(default)


def _filled(present: Column, value: Column, type_name: str, default: Any) -> Column:
    """The value where present, else the default; both as text if their types do not go together."""
    if type_name == "variant":
        other = F.parse_json(F.lit(json.dumps(default, **_COMPACT)))
    elif default is None or _fits(default, type_name):
        other = F.lit(default)
    else:
        value = _text(value, type_name)
        other = F.lit(default if isinstance(default, str) else json.dumps(default, **_COMPACT))
    return F.when(present, value).otherwise(other)


def _fits(default: Any, type_name: str) -> bool:
    if isinstance(default, bool):
        return type_name == "boolean"
    if isinstance(default, (int, float)):
        return type_name in ("tinyint", "smallint", "int", "bigint", "float", "double")
    return isinstance(default, str) and type_name == "string"


def typed_number(value: Column, type_name: str) -> Column:
    """Number of a typed or VARIANT column; what is not a number gives NULL."""
    return value_number(value) if type_name == "variant" else to_number(value, type_name)


def rules_json(record: Column, rules: Rules) -> Column:
    """JSON text of the new record, from a VARIANT object.

    Here absent and null differ: a default stands in for an absent member only.
    A member without value and default is left out; a number that cannot be
    computed prints as null.
    """
    if not rules:
        return F.to_json(record)
    return once(record, lambda r: object_text([_fragment(r, name, rule) for name, rule in rules.items()]))


def _fragment(record: Column, name: str, rule: dict[str, Any]) -> Column:
    """``"name":value``, or NULL if the rule gives nothing."""
    default = F.lit(json.dumps(rule["default"], **_COMPACT) if "default" in rule else None).cast("string")
    text = default
    if rule.get("source"):
        found = member(record, rule["source"])
        text = once(found, lambda value: F.when(value.isNotNull(), _json(value, rule)).otherwise(default))
    return F.concat(F.lit(json.dumps(name, **_COMPACT) + ":"), text)


def _json(value: Column, rule: dict[str, Any]) -> Column:
    transform = rule.get("transform")
    if transform == "uppercase":
        return quote(F.upper(value_text(value)))
    if transform == "lowercase":
        return quote(F.lower(value_text(value)))
    if transform in ("multiply", "round"):
        number = value_number(value)
        if transform == "multiply":
            number = number * F.lit(float(rule.get("factor") or 1))
        else:
            number = round_half_up(number)
        return F.coalesce(finite_text(number), F.lit("null"))
    return value_json(value)
