"""Joins of frames: by key, and as of a time. Spark picks broadcast or sort-merge by measured size."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..frame import Frame

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "semi": "left_semi", "anti": "left_anti"}


def merge(left: Frame, right: Frame, how: str = "inner", on: str | list[str] | None = None, left_on: str | list[str] | None = None, right_on: str | list[str] | None = None, suffixes: tuple[str, str] = ("_x", "_y")) -> Frame:
    """Keys are those of ``on``, else of ``left_on`` and ``right_on``, else all common names; other common names get suffixes.

    Missing keys match nothing.
    """
    from ..frame import Frame

    as_list = lambda x: [x] if isinstance(x, str) else list(x)
    if on is None and left_on is None:
        on = [c for c in left.columns if c in right.columns]
    lk, rk = (as_list(on), as_list(on)) if on is not None else (as_list(left_on), as_list(right_on))
    shared = [a for a, b in zip(lk, rk, strict=True) if a == b]
    clash = [c for c in left.columns if c in right.columns and c not in shared]
    a = left.sdf.select(*[F.col(f"`{c}`").alias(c + suffixes[0] if c in clash else c) for c in left.columns])
    b = right.sdf.select(*[F.col(f"`{c}`").alias("__r_" + c if c in shared else c + suffixes[1] if c in clash else c) for c in right.columns])
    ln = [c + suffixes[0] if c in clash else c for c in lk]
    rn = ["__r_" + c if c in shared else c + suffixes[1] if c in clash else c for c in rk]
    joined = a.join(b, [a[x] == b[y] for x, y in zip(ln, rn, strict=True)], HOW[how])
    if how in ("semi", "anti"):
        return Frame(joined, a.columns)
    joined = joined.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.col(f"`__r_{c}`")) for c in shared}) if shared else joined
    names = [*a.columns, *[c for c in b.columns if not c.startswith("__r_")]]
    return Frame(joined, names)


def merge_asof(left: Frame, right: Frame, on: str, by: str | list[str] | None = None, allow_exact: bool = True) -> Frame:
    """Each left row with the last right row at or before its time, of the same key.

    Both sides are laid together in time order and the right side's row is carried forward: one shuffle by key, no join. At equal times the
    right rows come first. Without ``by`` rows are carried over ranges of time, in two phases.
    """
    from ..frame import Frame

    keys = [] if by is None else [by] if isinstance(by, str) else list(by)
    carried = [c for c in right.columns if c != on and c not in keys]
    names = [c for c in left.columns if c != on and c not in keys]
    if clash := [c for c in carried if c in names]:
        raise ValueError(f"both frames have {clash}")
    a = left.sdf.select(*[F.col(f"`{c}`") for c in [on, *keys, *names]], F.lit(1 if allow_exact else 0).alias("__side"), F.lit(None).cast(right.sdf.select(F.struct(*carried).alias("s")).schema["s"].dataType).alias("__row"), F.lit(True).alias("__left"))
    b = right.sdf.select(*[F.col(f"`{c}`") for c in [on, *keys]], *[F.lit(None).cast(left.sdf.schema[c].dataType).alias(c) for c in names], F.lit(0 if allow_exact else 1).alias("__side"), F.struct(*carried).alias("__row"), F.lit(False).alias("__left"))
    both: DataFrame = a.unionByName(b)
    order = [on, "__side"]
    if keys:
        found = both.withColumn("__found", F.last("__row", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        from .ordering import carry

        found = carry(both, order, "__row", "__found")
    out = found.where("__left").select(*[F.col(f"`{c}`") for c in left.columns], *[F.col("__found")[c].alias(c) for c in carried])
    return Frame(out, [*left.columns, *carried], order=left.order, by=left.by)
