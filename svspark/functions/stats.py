"""Statistics with the engine's conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_nth(x, p: float = 0.5) -> Column:
    """A3: element floor(n*p) of the sorted non-null values; nothing is averaged."""
    return F.get(F.array_sort(F.collect_list(x)), F.floor(F.count(x) * F.lit(p)).cast("int"))


def reverse_complement(x) -> Column:
    """a-z upper-cased, ACGT complemented, the whole string turned round; other symbols keep their letter."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.reverse(F.translate(F.translate(x, low, up), "ACGT", "TGCA"))
