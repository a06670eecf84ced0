"""Text expressions that stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character left alone."""
    return F.translate(text, UPPER, UPPER.lower())


def split_words(text: Column, separators: str) -> Column:
    """The pieces of ``text`` between runs of ``separators`` (a Java character class); null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{separators}+"), "")


BLANKS = r"[ \t\n\x0B\f\r]"
"""Space and the control characters U+0009 to U+000D. Named one by one: Java looks such classes up in a table and walks through ranges."""

NOT_WORD = "[" + "".join(rf"\x{c:02X}" for c in range(128) if not (chr(c).isdigit() or chr(c).islower())) + "]"
"""ASCII that is neither digit nor lower-case letter; all beyond ASCII belongs to words."""


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_lengths(values: Column) -> Column:
    """``(value, n)`` of a list's distinct values in order and how often it holds each; nulls in it are not counted.

    The list is sorted and cut where neighbours differ, within the row: no shuffle, and time in proportion to sorting.
    """

    def cut(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        ends = lambda starts: F.transform(F.slice(starts, 1, F.size(starts) - 1), lambda a, k: F.struct(F.get(s, a).alias("value"), (F.get(starts, k + 1) - a).alias("n")))
        return bound(at, ends)

    return bound(F.sort_array(F.array_compact(values)), cut)
