"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time per row.

    Inside a conditional branch Spark does not share repeated subexpressions.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
