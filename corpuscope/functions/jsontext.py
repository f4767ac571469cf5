"""JSON text: strict parsing, exact printing, text of JSON values.

A VARIANT column stands for a JSON value. SQL NULL is an absent value, a
variant null is JSON null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.functions.binding import once
from corpuscope.functions.numbers import finite_text, number_text, text_to_number
from corpuscope.session import configure

JSON_TYPE = "application/json"

# What stands for the value of a text that is no JSON, and of JSON that no variant can hold.
PARSE_ERROR = "SyntaxError: not valid JSON"
TOO_LARGE = "RangeError: JSON value too large"

# Nothing but JSON is read, and the parser's own limits on strings, names, numbers and nesting are
# lifted, as they lie far below what a variant holds.
NO_LIMITS = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "maxStringLen": "2147483647",
    "maxNameLen": "2147483647",
    "maxNumLen": "2147483647",
    "maxNestingDepth": "2147483647",
}


def _seal(text: Column) -> Column:
    return F.crc32(text.cast("binary")).cast("string")


def _with_seal(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit(',"'), _seal(text), F.lit('"]'))


def _sealed(text: Column) -> Column:
    """The text as first item of an array whose second item is the text's checksum.

    The built-in parser stops behind the first value and so takes
    ``{"a":1} x``. Inside the array anything left over breaks it, adds an item
    or hides the second one, and no text can supply its own checksum.
    """
    return F.from_json(_with_seal(text), "variant", NO_LIMITS)


def _unseal(pair: Column, text: Column) -> Column:
    whole = F.try_variant_get(pair, "$[1]", "string") == _seal(text)
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def parse_json(text: Column) -> Column:
    """VARIANT of a JSON text, NULL where the text is not one whole JSON value.

    NULL also where the value takes more than a variant may (128 MB); :func:`json_error`
    tells the two apart.
    """
    active = SparkSession.getActiveSession()
    if active is not None:  # how repeated member names are read is a setting
        configure(active)
    return once(_sealed(text), lambda pair: _unseal(pair, text))


def valid_json(text: Column) -> Column:
    """Whether a text is one JSON value, of any size; its parts are not turned into values."""
    parts = F.from_json(_with_seal(text), "array<string>", NO_LIMITS)
    return F.coalesce(F.get(parts, F.lit(1)) == _seal(text), F.lit(False))


def json_error(value: Column, text: Column) -> Column:
    """Why a text has no value: it is no JSON, or JSON beyond a variant; NULL where it has one, or there is no text.

    Only texts without a value are read again, member by member, which needs no room for the whole.
    """
    reason = F.when(valid_json(text), TOO_LARGE).otherwise(PARSE_ERROR)
    return F.when(value.isNull() & text.isNotNull(), reason)


def with_json(df: DataFrame, name: str, text: Column, condition: Column | None = None) -> DataFrame:
    """Add :func:`parse_json` of a text as a column, for the rows that meet the condition.

    The unchecked value is a column of its own, which keeps all of it in
    generated code.
    """
    configure(df.sparkSession)
    pair = _sealed(text) if condition is None else F.when(condition, _sealed(text))
    sealed = df.withColumn("_sealed", pair)
    return sealed.withColumn(name, _unseal(F.col("_sealed"), text)).drop("_sealed")


def quote(text: Column) -> Column:
    """Text as a JSON string."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


# First letters of a VARIANT's schema, which tell the kinds apart.
OBJECT, ARRAY, STRING, NULL, BOOLEAN, WHOLE = "OBJ", "ARR", "STR", "VOI", "BOO", "BIG"
NUMBERS = ["DEC", "DOU", "FLO"]


def kind(value: Column) -> Column:
    """Kind of a VARIANT: one of the constants above."""
    return F.substring(F.schema_of_variant(value), 1, 3)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value) == OBJECT, F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(kind(value) == ARRAY, F.lit(False))


def scalar_text(value: Column) -> Column:
    """String form of a VARIANT; of arrays only the JSON text.

    Here and below ``value`` is a column, or bound by :func:`once`: it appears
    several times in the result.
    """

    def text(k: Column) -> Column:
        return (
            F.when(k == NULL, "null")
            .when(k == OBJECT, "[object Object]")
            .when(k.isin(*NUMBERS), number_text(F.try_variant_get(value, "$", "double")))
            .otherwise(F.try_variant_get(value, "$", "string"))
        )

    return once(kind(value), text)


def value_text(value: Column) -> Column:
    """String form of a VARIANT; an array is its items joined by commas.

    Arrays inside arrays appear as JSON text.
    """
    items = F.coalesce(
        F.when(kind(value) == ARRAY, F.try_variant_get(value, "$", "array<variant>")),
        F.when(~F.is_variant_null(value), F.array(value)),
    )
    texts = F.transform(items, lambda item: F.when(~F.is_variant_null(item), scalar_text(item)))
    return F.when(F.is_variant_null(value), "null").otherwise(F.array_join(texts, ",", ""))


def value_number(value: Column) -> Column:
    """Number of a VARIANT: null is 0, text that is no number is NULL."""

    def number(k: Column) -> Column:
        return (
            F.when(k == NULL, F.lit(0.0))
            .when(k == BOOLEAN, F.try_variant_get(value, "$", "boolean").cast("int").cast("double"))
            .when(k.isin(STRING, ARRAY), once(value_text(value), text_to_number))
            .when(k != OBJECT, F.try_variant_get(value, "$", "double"))
        )

    return once(kind(value), number)


def value_json(value: Column) -> Column:
    """JSON text of a VARIANT, a number printed as :func:`number_text` does."""
    number = F.try_variant_get(value, "$", "double")
    text = F.coalesce(finite_text(number), F.lit("null"))
    return F.when(kind(value).isin(*NUMBERS), text).otherwise(F.to_json(value))


def member(record: Column, key: str) -> Column:
    """Member of a VARIANT object, NULL if absent."""
    if re.fullmatch(r"[\w $:/@+-]+", key):
        return F.try_variant_get(record, f"$['{key}']", "variant")
    # a path cannot spell every name
    return F.try_element_at(F.try_variant_get(record, "$", "map<string,variant>"), F.lit(key))


def is_json_type(content_type: Column) -> Column:
    """Whether a content type says JSON, in this letter case."""
    return F.coalesce(F.contains(content_type, F.lit(JSON_TYPE)), F.lit(False))


def json_body(content_type: Column, body: Column) -> Column:
    """Parsed body if the content type says JSON, else (or if broken, or beyond a variant) NULL."""
    return F.when(is_json_type(content_type), parse_json(body))


def json_object_or_empty(text: Column) -> Column:
    """JSON text of the object in ``text``; anything else gives ``{}``.

    An object beyond a variant comes back as it was given.
    """

    def found(value: Column) -> Column:
        large = (json_error(value, text) == TOO_LARGE) & F.ltrim(text).startswith("{")
        return F.when(is_object(value), F.to_json(value)).when(large, text).otherwise(F.lit("{}"))

    return once(parse_json(text), found)


def object_text(fragments: list[Column]) -> Column:
    """JSON object text from ``"key":value`` fragments; NULL fragments are left out."""
    return F.concat(F.lit("{"), F.array_join(F.array(*fragments), ","), F.lit("}"))


def stringify(value: Column, data_type: T.DataType, pad: str = "\n", absent_null: bool = False) -> Column:
    """JSON text with two blanks per level, member by line.

    Built from the column's type. NULL prints as null; with ``absent_null`` the
    NULL members of a struct are left out instead.
    """
    inner = pad + "  "

    def lines(parts: Column, opening: str, closing: str) -> Column:
        body = F.concat(F.lit(opening + inner), F.array_join(parts, "," + inner), F.lit(pad + closing))
        return F.when(F.size(parts) == 0, opening + closing).otherwise(body)

    if isinstance(data_type, T.StructType):
        parts = []
        for field in data_type.fields:
            item = value.getField(field.name)
            text = F.concat(quote(F.lit(field.name)), F.lit(": "), stringify(item, field.dataType, inner, absent_null))
            parts.append(F.when(item.isNotNull(), text) if absent_null else text)
        text = lines(F.array_compact(F.array(*parts)), "{", "}")
    elif isinstance(data_type, T.ArrayType):
        items = F.transform(value, lambda item: stringify(item, data_type.elementType, inner, absent_null))
        text = lines(items, "[", "]")
    elif isinstance(data_type, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda entry: F.concat(
                quote(entry.getField("key").cast("string")),
                F.lit(": "),
                stringify(entry.getField("value"), data_type.valueType, inner, absent_null),
            ),
        )
        text = lines(entries, "{", "}")
    elif isinstance(data_type, T.VariantType):
        text = value_json(value)
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = finite_text(value.cast("double"))
    elif isinstance(data_type, (T.IntegralType, T.BooleanType, T.DecimalType)):
        text = value.cast("string")
    elif isinstance(data_type, T.TimestampType):
        utc = F.to_utc_timestamp(value, F.current_timezone())
        text = quote(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    else:
        text = quote(value.cast("string"))
    return F.coalesce(text, F.lit("null"))
