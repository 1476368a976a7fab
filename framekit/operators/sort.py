"""Sorts and top-k. Order is made total by the frame's order key, so that every sort is stable."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ordering
from .ordering import POS

if TYPE_CHECKING:
    from ..frame import Frame, Series


def _key(c: Column, ascending: bool, last: bool) -> Column:
    if ascending:
        return c.asc_nulls_last() if last else c.asc_nulls_first()
    return c.desc_nulls_last() if last else c.desc_nulls_first()


def sort_values(frame: Frame, by: str | list[str], ascending: bool | list[bool] = True, na_position: str = "last") -> Frame:
    """A range sort; the result's order is its place, in ``__rank`` once it is asked for."""
    names = [by] if isinstance(by, str) else list(by)
    ways = [ascending] * len(names) if isinstance(ascending, bool) else ascending
    keys = [_key(F.col(f"`{n}`"), a, na_position == "last") for n, a in zip(names, ways, strict=True)]
    rest = [F.col(o) for o in frame.order if o not in names]
    out = frame._with(frame.sdf.orderBy(*keys, *rest))
    out.sort_keys = [*keys, *rest]
    return out


def ranked(frame: Frame, name: str = "rank") -> Frame:
    """A sorted frame with each row's place, by ranges of the sort key rather than in one task."""
    keys = getattr(frame, "sort_keys", None) or [F.col(o) for o in frame.order]
    placed = ordering.positions(frame.sdf, keys).withColumnRenamed(POS, name)
    return frame._with(placed, [*frame.columns, name], order=[name], by=[])


def extremes(series: Series, n: int, largest: bool) -> Series:
    """The n largest or smallest, ties by order: each task keeps n rows."""
    frame = series.to_frame()
    c = F.col(f"`{frame.columns[0]}`")
    kept = frame.sdf.orderBy(_key(c, not largest, True), *frame.order).limit(max(0, n))
    return frame._with(kept)[frame.columns[0]]


def argsort(series: Series) -> Series:
    """At each place the position (among known values) of the value that sorts there; -1 at the places of missing values.

    Known rows are numbered in order, and sorted; the k-th known place gets the number of the k-th value.
    """
    frame = series.frame
    name = series.name or "value"
    sdf = frame.sdf.withColumn("__v", series.expr)
    known = ordering.positions(sdf.where("__v is not null").select(*frame.order, "__v"), frame.order).withColumnRenamed(POS, "__nth")
    by_value = ordering.positions(known.select("__v", "__nth"), ["__v", "__nth"]).select(F.col(POS).alias("__place"), F.col("__nth").alias("__arg"))
    placed = known.select(*frame.order, F.col("__nth").alias("__place")).join(by_value, "__place").drop("__place")
    out = frame.sdf.join(placed, frame.order, "left").withColumn(name, F.coalesce("__arg", F.lit(-1))).drop("__arg")
    return frame._with(out, list(dict.fromkeys([*frame.columns, name])))[name]
