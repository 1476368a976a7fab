"""Group-by: rows without a key are dropped, other groups reduce like columns do. Partial aggregation before the shuffle is Spark's."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reduce import reduction

if TYPE_CHECKING:
    from ..frame import Frame


class GroupBy:
    def __init__(self, frame: Frame, keys: list[str], sort: bool = True, as_index: bool = True, selected: list[str] | None = None):
        if gone := [k for k in keys if k not in frame.columns]:
            raise KeyError(gone)
        self.frame, self.keys, self.sort, self.as_index, self.selected = frame, keys, sort, as_index, selected

    def __getitem__(self, key: str | list[str] | tuple[str, ...]) -> GroupBy:
        if self.selected is not None:
            raise IndexError("columns are selected already")
        names = [key] if isinstance(key, str) else list(key)
        if gone := [c for c in names if c not in self.frame.columns]:
            raise KeyError(gone)
        return GroupBy(self.frame, self.keys, self.sort, self.as_index, names)

    @property
    def columns(self) -> list[str]:
        return self.selected or [c for c in self.frame.columns if c not in self.keys]

    def _rows(self) -> DataFrame:
        known = F.lit(True)
        for k in self.keys:
            known &= F.col(f"`{k}`").isNotNull()
        return self.frame.sdf.where(known)

    def _frame(self, sdf: DataFrame, names: list[str]) -> Frame:
        """Sorted groups are a matter of the frame's order key: sinks that need rows in order sort, others save the shuffle."""
        from ..frame import Frame

        return Frame(sdf, names if self.as_index else [*self.keys, *names], index=self.keys if self.as_index else (), order=self.keys if self.sort else ())

    def agg(self, how: str | dict[str, str | Callable[[Column], Column]] | Callable[[Column], Column]) -> Frame:
        """By the name of a reduction or by a function from a column to an aggregate; a dictionary for columns of their own."""
        plan = how if isinstance(how, dict) else dict.fromkeys(self.columns, how)
        made = [(reduction(f, F.col(f"`{c}`")) if isinstance(f, str) else f(F.col(f"`{c}`"))).alias(c) for c, f in plan.items()]
        return self._frame(self._rows().groupBy(*self.keys).agg(*made), list(plan))

    def agg_python(self, function: Callable, returns: str = "double") -> Frame:
        """By a Python function of a pandas Series of a group's values; an expression is to be preferred. A group goes to one task."""
        from ..functions.udf import group_function

        f = group_function(function, returns)
        return self._frame(self._rows().groupBy(*self.keys).agg(*[f(F.col(f"`{c}`")).alias(c) for c in self.columns]), self.columns)

    def reduce(self, name: str, **options) -> Frame:
        return self._frame(self._rows().groupBy(*self.keys).agg(*[reduction(name, F.col(f"`{c}`"), **options).alias(c) for c in self.columns]), self.columns)


for _name in ("count", "sum", "mean", "median", "min", "max", "prod", "std", "var", "nunique", "skew"):
    setattr(GroupBy, _name, (lambda n: lambda self, **options: self.reduce(n, **options))(_name))


MAX_NAMES = 10_000


def pivot_table(frame: Frame, index: str | list[str], columns: str, values: str, aggfunc: str = "mean", names: list | None = None) -> Frame:
    """A row for each index value, a column for each name. Without ``names`` a first job finds them; over ``MAX_NAMES`` are an error."""
    from ..frame import Frame

    keys = [index] if isinstance(index, str) else list(index)
    if names is None:
        found = frame.sdf.select(columns).where(F.col(columns).isNotNull()).distinct()
        names = sorted(r[0] for r in found.limit(MAX_NAMES + 1).collect())
        if len(names) > MAX_NAMES:
            raise ValueError(f"{columns} has more than {MAX_NAMES} values to make columns of")
    out = frame.sdf.groupBy(*keys).pivot(columns, names).agg(reduction(aggfunc, F.col(values)))
    return Frame(out, [str(n) for n in names], index=keys, order=keys)


def crosstab(frame: Frame, index: str, columns: str, names: list | None = None) -> Frame:
    """Counts of rows for each pair of values, 0 where there are none."""
    counted = pivot_table(frame.set_column("__one", F.lit(1)), index, columns, "__one", "count", names)
    return counted.fillna(0)
