"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Column functions paste their argument everywhere they use it, so nested ones grow
    exponentially in the plan. A lambda variable keeps the tree linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
