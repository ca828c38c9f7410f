"""One value for many uses in an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f mentions it; null where the value is."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
