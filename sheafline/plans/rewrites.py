"""Rewrites the optimiser does not make by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types whose sums and differences fit a bigint, and the type for all others.
NARROW = ("tinyint", "smallint", "int")
WIDE = "decimal(20,0)"


def wide_type(kinds: list[str], constant: int) -> str:
    """The type in which columns of these types and the constant cannot overflow."""
    return "bigint" if all(k in NARROW for k in kinds) and abs(constant) < 2**62 else WIDE


def equality(x: Column, y: Column, sign: str, constant: int, flipped: bool = False, wide: str = WIDE) -> Column:
    """A join condition with one side per table, so that it hashes.

    ``x`` and ``y`` are columns of the left and right table. Without ``sign``
    it is ``x == y``, otherwise ``x sign y == constant``, or ``y sign x`` if
    ``flipped``, solved for ``x`` and computed as ``wide``.
    """
    if not sign:
        return x == y
    k, x, y = F.lit(constant).cast(wide), x.cast(wide), y.cast(wide)
    if sign == "+":
        return x == k - y
    return x == y - k if flipped else x == k + y
