"""Aggregate expressions Spark does not have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_avg(c: Column, whole: bool = True) -> Column:
    """The average rounded up, exact in whole numbers for whole numbers."""
    if not whole:
        return F.ceil(F.avg(c)).cast("bigint")
    total, n = F.sum(c.cast("bigint")), F.count(c)
    # whole division cuts towards zero and the rest has the sign of the total
    return F.when(n > 0, F.call_function("div", total, n) + (total % n > 0).cast("bigint"))
