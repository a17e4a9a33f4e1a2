"""Whole-number arithmetic that never passes through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, n: int) -> Column:
    """a div n, exact over all of BIGINT; for non-negative a the floor."""
    return F.call_function("div", a.cast("long"), F.lit(n).cast("long"))
