"""Binary operators with the reference semantics: float64 results, Python's floor rules, missing values compare False."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import ieee_div, known


def _double(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: known(f(a.cast("double"), b.cast("double")))


def floordiv(a: Column, b: Column) -> Column:
    """floor(a / b) as a double; infinite as the division is, and a zero has its sign. From 2^53 on doubles are whole (and soon beyond Spark's floor, a long)."""
    q = ieee_div(a, b)
    return F.when((q != 0) & (F.abs(q) < 2.0**53), F.floor(q).cast("double")).otherwise(q)


def mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; NULL (for NaN) by zero. A remainder of zero is positive."""
    a, b = a.cast("double"), b.cast("double")
    r = a % F.when(b != 0, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r + 0.0)


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "add": _double(lambda a, b: a + b),
    "sub": _double(lambda a, b: a - b),
    "mul": _double(lambda a, b: a * b),
    "div": ieee_div,
    "truediv": ieee_div,
    "floordiv": floordiv,
    "mod": mod,
    "pow": _double(lambda a, b: F.pow(a, b)),
}

COMPARISON: dict[str, Callable[[Column, Column], Column]] = {
    "lt": lambda a, b: F.coalesce(a < b, F.lit(False)),
    "gt": lambda a, b: F.coalesce(a > b, F.lit(False)),
    "le": lambda a, b: F.coalesce(a <= b, F.lit(False)),
    "ge": lambda a, b: F.coalesce(a >= b, F.lit(False)),
    "ne": lambda a, b: F.coalesce(a != b, F.lit(True)),
    "eq": lambda a, b: F.coalesce(a == b, F.lit(False)),
}


def with_fill(a: Column, b: Column, fill: Column | None) -> tuple[Column, Column]:
    """One side missing takes ``fill``; both missing stay missing."""
    if fill is None:
        return a, b
    return F.when(b.isNotNull(), F.coalesce(a, fill)).otherwise(a), F.when(a.isNotNull(), F.coalesce(b, fill)).otherwise(b)
