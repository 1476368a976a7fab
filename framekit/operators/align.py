"""Labels: alignment of two frames, lookup of one frame's values for another's labels, membership."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..frame import Frame, Series


def aligned(left: Series, right: Series, strict: bool = False) -> Frame:
    """Both series by label: a full outer join, with the cross product of repeated labels; NULL labels match nothing.

    Columns: the label, ``__left``, ``__right``. ``strict`` raises at run time if a label is on one side only.
    """
    from ..frame import Frame

    (a, an), (b, bn) = (s.frame.labelled() for s in (left, right))
    if len(an) != len(bn):
        raise ValueError("labels have different numbers of levels")
    labels = [f"__label{i}" for i in range(len(an))]
    a = a.select(*[F.col(n).alias(x) for n, x in zip(an, labels, strict=True)], left.expr.alias("__left"), F.lit(True).alias("__in_left"))
    b = b.select(*[F.col(n).alias(x) for n, x in zip(bn, labels, strict=True)], right.expr.alias("__right"), F.lit(True).alias("__in_right"))
    both = a.join(b, labels, "full")
    if strict:
        whole = F.col("__in_left").isNotNull() & F.col("__in_right").isNotNull()
        both = both.withColumn("__left", F.when(whole, F.col("__left")).otherwise(F.raise_error(F.lit("can only compare series with the same labels")).cast(both.schema["__left"].dataType)))
    return Frame(both.drop("__in_left", "__in_right"), [], index=labels, order=labels)


def reindexed(frame: Frame, values: Series, name: str, strict: bool = True) -> DataFrame:
    """The frame's rows with the values of their labels in column ``name``.

    A label that ``values`` has twice raises; with ``strict``, so does a label that it lacks.
    """
    sdf, labels = frame.labelled()
    other, names = values.frame.labelled()
    keys = [f"__k{i}" for i in range(len(names))]
    once = other.groupBy(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)]).agg(F.first(values.expr).alias(name), F.count("*").alias("__n"))
    on = [F.col(x) == F.col(k) for x, k in zip(labels, keys, strict=True)]
    found = sdf.join(once, on, "left").drop(*keys)
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("cannot reindex on a repeated label")).cast(once.schema[name].dataType))
    if strict:
        checked = checked.when(F.col("__n").isNull(), F.raise_error(F.lit("a label of the frame is not in the mask")).cast(once.schema[name].dataType))
    return found.withColumn(name, checked.otherwise(F.col(name))).drop("__n")


def frame_isin(frame: Frame, values) -> Frame:
    """By values, by a dictionary of values for each column, by a Series of the same labels or a Frame of the same labels and columns."""
    from ..frame import Frame, Series

    member = lambda c, vs: F.coalesce(c.isin([v for v in vs if v is not None]), F.lit(False))
    if isinstance(values, dict):
        return frame._with(frame.sdf.withColumns({c: member(F.col(c), values[c]) if c in values else F.lit(False) for c in frame.columns}))
    if not isinstance(values, (Series, Frame)):
        return frame.each(lambda c: member(c, list(values)))
    other = values if isinstance(values, Frame) else values.to_frame("__value")
    sdf, labels = frame.labelled()
    theirs, names = other.labelled()
    keys = [f"__k{i}" for i in range(len(names))]
    wanted = {c: f"__v_{c}" for c in other.columns}
    # of repeated labels the first in order decides
    first = F.min_by(F.struct(*[F.col(c).alias(v) for c, v in wanted.items()]), F.struct(*(other.order or names)))
    once = theirs.groupBy(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)]).agg(first.alias("__row")).select(*keys, "__row.*")
    joined = sdf.join(once, [F.col(x) == F.col(k) for x, k in zip(labels, keys, strict=True)], "left")
    source = lambda c: F.col("__v___value") if isinstance(values, Series) else F.col(f"__v_{c}") if c in other.columns else F.lit(None)
    return frame._with(joined.withColumns({c: F.coalesce(F.col(c) == source(c), F.lit(False)) for c in frame.columns}).drop(*keys, *wanted.values()))
