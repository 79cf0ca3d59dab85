"""Names for values inside an expression: what stands in a lambda's body is evaluated each time, a lambda's argument once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))
