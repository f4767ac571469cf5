"""Number conversion, rounding and number text as a JavaScript user knows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.binding import once
from corpuscope.functions.text import trim_ws

_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_HEX = r"^0[xX][0-9a-fA-F]+$"
_HEX_DIGITS = 31  # as many fit a decimal of 38 digits


def text_to_number(text: Column) -> Column:
    """Number of a string: blank is 0, text that is no number is NULL."""

    def parsed(trimmed: Column) -> Column:
        return (
            F.when(trimmed == "", F.lit(0.0))
            .when(trimmed.rlike(_DECIMAL), trimmed.try_cast("double"))
            .when(trimmed.rlike(_HEX), _hex_number(F.regexp_replace(F.substr(trimmed, F.lit(3)), "^0+(?=.)", "")))
        )

    return once(trim_ws(text), parsed)


def _hex_number(digits: Column) -> Column:
    """Double nearest to a hexadecimal number of any length, without leading zeros.

    31 digits are summed as a decimal, which a cast rounds once; if any of the rest is
    not zero the last bit stands for it, and the rest only moves the exponent.
    """

    def part(first: int, size: int) -> Column:
        taken = F.conv(F.nullif(F.substring(kept, first, size), F.lit("")), 16, 10)
        return F.coalesce(taken, F.lit("0")).cast("decimal(38,0)")

    rest = F.greatest(F.length(digits) - _HEX_DIGITS, F.lit(0))
    kept = F.lpad(F.substring(digits, 1, _HEX_DIGITS), _HEX_DIGITS, "0")
    total = (part(1, 10) * F.lit(16**10).cast("decimal(19,0)")).cast("decimal(38,0)") + part(11, 10)
    total = (total.cast("decimal(25,0)") * F.lit(16**11).cast("decimal(14,0)")).cast("decimal(38,0)") + part(21, 11)
    sticky = F.when(F.substr(digits, F.lit(_HEX_DIGITS + 1)).rlike("[1-9a-fA-F]"), 1).otherwise(0)
    odd = F.substring(kept, -1, 1).rlike("[13579bdfBDF]")
    exact = total.cast("decimal(38,0)") + F.when(odd, 0).otherwise(sticky).cast("decimal(1,0)")
    return exact.cast("double") * F.pow(F.lit(16.0), rest)


def finite_text(number: Column) -> Column:
    """:func:`number_text` of a double; NULL for one that is infinite or no number, which JSON cannot say."""
    finite = F.abs(number) < F.lit(float("inf"))  # NaN is above every number
    return F.when(finite, number_text(number))


def to_number(value: Column, type_name: str) -> Column:
    """Number of a typed column; what is not a number gives NULL."""
    if type_name == "string":
        return text_to_number(value)
    if type_name == "boolean":
        return value.cast("int").cast("double")
    return value.try_cast("double")


def round_half_up(number: Column) -> Column:
    """Round a double half toward plus infinity; -2.5 gives -2.

    Comparing the fraction with one half, instead of adding one half, keeps
    0.49999999999999994 at 0.
    """
    down = F.floor(number)
    whole = (down + F.when(number - down >= 0.5, 1).otherwise(0)).cast("double")
    # from 2^52 on every double is whole, and floor() would leave the long range
    return F.when(F.abs(number) < F.lit(2.0**52), whole).otherwise(number)


def number_text(number: Column) -> Column:
    """Decimal text of a double: 5 for 5.0, plain digits from 1e-6 up to 1e21."""

    def from_java(value: Column, java: Column) -> Column:
        size = F.abs(value)
        plain = F.when(java.endswith(".0"), F.substring_index(java, ".", 1)).otherwise(java)
        digits = F.when(size < 1, java.try_cast("decimal(38,28)").cast("string")).otherwise(
            java.try_cast("decimal(38,17)").cast("string")
        )
        # 1.0E-7 and 1.5E21 become 1e-7 and 1.5e+21
        power = F.regexp_replace(F.regexp_replace(java, r"(\.0)?E", "e"), r"e(?=\d)", "e+")
        return (
            F.when(value == 0, "0")
            .when(~java.contains("E"), plain)
            .when((size >= 1e21) | (size < 1e-6), power)
            .otherwise(F.regexp_replace(digits, r"\.?0+$", ""))
        )

    return once(number, lambda value: once(value.cast("string"), lambda java: from_java(value, java)))
