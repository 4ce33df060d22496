"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column) -> Column:
    """num/den as double, null where den is 0 or null."""
    return num.cast("double") / F.when(den != 0, den.cast("double"))


def r6(c: Column | str) -> Column:
    """Round to six digits without a negative zero."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def bit(mask: Column | str, pos: int) -> Column:
    """Bit ``pos`` of an integer mask as 0/1."""
    return F.shiftrightunsigned(col(mask), pos).bitwiseAND(F.lit(1).cast("long"))
