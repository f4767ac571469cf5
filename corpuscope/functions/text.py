"""Text statistics and previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.binding import once

# The characters counted as white space, as a Java character class.
# Java's own \s leaves the Unicode spaces out. The part in front of && is a cheap
# test that most letters fail, so the exact test seldom runs.
WS = (
    r"[\t-\r \u00a0\u1680-\ufeff&&"
    r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]"
)

# White space other than blank and newline.
RARE_WS = WS.replace(r"\t-\r ", r"\t\x0B-\r", 1)


def trim_ws(text: Column) -> Column:
    """Strip white space, Unicode spaces included, from both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapse_ws(text: Column) -> Column:
    """Every run of white space becomes one blank.

    In a text without rare white space, which is nearly every text, only runs of
    blanks are left to replace; that takes half the time.
    """
    plain = F.replace(text, F.lit("\n"), F.lit(" "))
    rare = F.regexp_replace(plain, f"{WS}+", " ")
    return F.when(plain.rlike(RARE_WS), rare).otherwise(F.regexp_replace(plain, " {2,}", " "))


def _occurrences(text: Column, char: str) -> Column:
    """How often an ASCII character occurs."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def count_words(text: Column) -> Column:
    """Number of runs of non-white-space characters.

    The blanks between words are counted, so a text of any length needs no list of
    its words.
    """
    gaps = once(
        F.trim(collapse_ws(text)), lambda line: F.when(line == "", 0).otherwise(_occurrences(line, " ") + 1)
    )
    return gaps.cast("bigint")


def count_lines(text: Column) -> Column:
    """Newlines plus one."""
    return (_occurrences(text, "\n") + 1).cast("bigint")


def char_count(text: Column) -> Column:
    """Length in UTF-16 units: a character outside the BMP counts twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def preview_chars(text: Column, units: int = 100) -> Column:
    """First ``units`` UTF-16 units.

    A pair cut in half cannot be stored in UTF-8; its first half is left out.
    """
    head = F.substring(text, 1, units)
    utf16 = F.encode(head, "UTF-16BE")
    last_unit = F.hex(F.substring(utf16, 2 * units - 1, 1))
    kept = F.when(last_unit.between("D8", "DB"), 2 * units - 2).otherwise(2 * units)
    cut = F.decode(utf16.substr(F.lit(1), kept), "UTF-16BE")
    return F.when(F.octet_length(utf16) <= 2 * units, head).otherwise(cut)


def preview_lines(text: Column, lines: int = 10) -> Column:
    """First ``lines`` lines."""
    return F.substring_index(text, "\n", lines)
