"""Column helpers for operators that use built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regular-expression class of ASCII white space, and its characters.
GAP = r"[\x20\x09-\x0D]"
GAP_CHARS = "\t\n\x0b\x0c\r "


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda's variable is not inlined as a projected column may be."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(text, GAP + "+"), "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(GAP_CHARS))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)
