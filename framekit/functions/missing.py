"""NULL is the one missing value; IEEE rules where the operations need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def nan_to_null(sdf: DataFrame) -> DataFrame:
    """The scan boundary: NaN in float columns becomes NULL."""
    return sdf.select(*[known(F.col(f"`{c}`")).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in sdf.dtypes])


def known(c: Column) -> Column:
    """c, with NaN as NULL."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """c where it is a finite number, else NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < INF), c)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b as doubles: infinite where only b is zero, NULL (for NaN) where both are."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b != 0, a / F.when(b != 0, b)).when(b == 0, by_zero)
