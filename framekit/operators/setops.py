"""Rows of several frames: append and concat keep all; union, intersection and difference are of distinct rows."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..frame import Frame


def append(frame: Frame, other: Frame | list[Frame], ignore_index: bool = False) -> Frame:
    """UNION ALL; columns of either, NULL where a frame lacks one. Order is by frame, then by each frame's own order."""
    frames = [frame, *(other if isinstance(other, list) else [other])]
    columns = list(dict.fromkeys(c for f in frames for c in f.columns))
    order = list(dict.fromkeys(o for f in frames for o in f.order))
    index = [] if ignore_index else frame.index_columns
    out = None
    for i, f in enumerate(frames):
        keep = list(dict.fromkeys([*f.columns, *([] if ignore_index else f.index_columns), *f.order]))
        part = f.sdf.select(*[F.col(f"`{c}`") for c in keep], F.lit(i).alias("__frame"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return frame._with(out, columns, index=index, order=["__frame", *order], by=[])


def concat(frames: list[Frame], axis: int = 0, ignore_index: bool = False) -> Frame:
    """Along rows, or along columns by position (``axis=1``); names must then differ."""
    if axis == 0:
        return append(frames[0], frames[1:], ignore_index)
    from ..frame import Frame
    from .ordering import POS

    out = frames[0].positioned().select(POS, *frames[0].columns)
    for f in frames[1:]:
        out = out.join(f.positioned().select(POS, *f.columns), POS, "full")
    return Frame(out, [c for f in frames for c in f.columns], order=[POS])


def union(a: Frame, b: Frame) -> Frame:
    return a._with(a.spark().unionByName(b.spark()).distinct())


def intersect(a: Frame, b: Frame) -> Frame:
    return a._with(a.spark().intersect(b.spark()))


def difference(a: Frame, b: Frame) -> Frame:
    return a._with(a.spark().subtract(b.spark()))
