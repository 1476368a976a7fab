"""Ordered, whole-series operations. With a partition key they are windows; without one they are two-phase scans and halos."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.missing import ieee_div
from . import ordering
from .ordering import POS

if TYPE_CHECKING:
    from ..frame import Frame, Series


def _moved(frame: Frame, column: str, periods: int, name: str, fill=None) -> Frame:
    """The frame with ``column`` of the row ``periods`` before."""
    move = lambda w: F.lag(column, periods, fill).over(w) if periods >= 0 else F.lead(column, -periods, fill).over(w)
    if frame.by:
        return frame._with(frame.sdf.withColumn(name, move(frame.window())))
    spread = ordering.with_halo(frame.sdf.drop(POS), frame.order, max(0, periods), max(0, -periods))
    return frame._with(spread.withColumn(name, move(Window.partitionBy("__bucket").orderBy(POS))).where("__own").drop("__own", "__bucket"))


def shift(series: Series, periods: int = 1, fill_value=None) -> Series:
    name = series.name or "value"
    frame = series.frame._with(series.frame.sdf.withColumn("__src", series.expr))
    frame = _moved(frame, "__src", periods, name, fill_value)
    return frame._with(frame.sdf.drop("__src"), list(dict.fromkeys([*series.frame.columns, name])))[name]


def cumsum(series: Series, skipna: bool = True) -> Series:
    """Missing values stay missing; the sum goes on after them, or with ``skipna=False`` ends at the first."""
    name, frame = series.name or "value", series.frame
    sdf = frame.sdf.withColumn("__src", series.expr)
    gap = F.col("__src").isNull().cast("long")
    if frame.by:
        w = frame.window().rowsBetween(Window.unboundedPreceding, 0)
        total, gaps = F.sum("__src").over(w), F.sum(gap).over(w)
    else:
        sdf = ordering.scan(sdf, frame.order, {"__sum": F.col("__src"), "__gaps": gap})
        total, gaps = F.col("__sum"), F.col("__gaps")
    value = F.when(F.col("__src").isNotNull() if skipna else gaps == 0, total)
    return frame._with(sdf.withColumn("__out", value).drop("__src", "__sum", "__gaps").withColumn(name, F.col("__out")).drop("__out"), list(dict.fromkeys([*frame.columns, name])))[name]


def pct_change(frame: Frame, periods: int = 1, fill_method: str | None = "pad", undefined: float | None = None) -> Frame:
    """x / x[periods before] - 1 of each number column, missing values filled from before (pad) or after (bfill) first.

    0 / 0 gives ``undefined``: NULL, the one missing value, or for equality with plain SQL NaN.
    """
    out, columns = frame, frame.columns
    for c in columns:
        sdf = out.sdf.withColumn("__fill", F.col(f"`{c}`").cast("double"))
        if fill_method in ("pad", "ffill"):
            if out.by:
                sdf = sdf.withColumn("__fill", F.last("__fill", ignorenulls=True).over(out.window().rowsBetween(Window.unboundedPreceding, 0)))
            else:
                sdf = ordering.carry(sdf, out.order, "__fill", "__fill")
        elif fill_method in ("bfill", "backfill"):
            if out.by:
                backwards = Window.partitionBy(*out.by).orderBy(*[F.col(c).desc() for c in out.order])
                sdf = sdf.withColumn("__fill", F.last("__fill", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0)))
            else:
                sdf = ordering.carry(sdf, out.order, "__fill", "__fill", back=True)
        moved = _moved(out._with(sdf), "__fill", periods, "__before")
        change = F.when((F.col("__fill") == 0) & (F.col("__before") == 0), F.lit(undefined).cast("double")).otherwise(ieee_div(F.col("__fill"), F.col("__before")) - 1)
        out = out._with(moved.sdf.withColumn(c, change).drop("__fill", "__before"))
    return out._with(out.sdf, columns)
