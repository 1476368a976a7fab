"""Frame and Series: lazy, pandas-style builders over Spark DataFrames.

A Frame is a Spark DataFrame with the names of its data columns, of its index columns (none: the position is the label), of the
columns that order its rows, and of the columns that part it into independent sequences. Nothing runs until a sink
asks. Operations on columns of one Frame are plain expressions; columns of different Frames meet by label.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .functions import missing, strings, temporal
from .functions.arithmetic import ARITHMETIC, COMPARISON, with_fill
from .operators import ordering
from .operators.ordering import POS

_lineage = itertools.count()


class Frame:
    def __init__(self, sdf: DataFrame, columns: Iterable[str] | None = None, index: Iterable[str] = (), order: Iterable[str] = (), by: Iterable[str] = ()):
        self.sdf, self.index_columns, self.order, self.by = sdf, list(index), list(order), list(by)
        hidden = set(self.index_columns)
        self._columns = list(columns) if columns is not None else [c for c in sdf.columns if c not in hidden and not c.startswith("__")]
        self.lineage = next(_lineage)

    @classmethod
    def of(cls, sdf: DataFrame, **keys) -> Frame:
        """The scan boundary: NaN becomes NULL."""
        return cls(missing.nan_to_null(sdf), **keys)

    def _with(self, sdf: DataFrame, columns: Iterable[str] | None = None, **keys) -> Frame:
        args = {"index": self.index_columns, "order": self.order, "by": self.by} | keys
        return Frame(sdf, self._columns if columns is None else columns, **args)

    # what a row is
    def window(self) -> WindowSpec:
        """Rows in order; parted by ``by``."""
        if not self.order:
            raise ValueError("this operation needs an order: Frame(..., order=[...])")
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def positioned(self) -> DataFrame:
        """The rows with their positions over the whole frame."""
        if POS in self.sdf.columns:
            return self.sdf
        if not self.order:
            raise ValueError("positions need an order: Frame(..., order=[...])")
        return ordering.positions(self.sdf, self.order)

    def labelled(self) -> tuple[DataFrame, list[str]]:
        """The rows and the names of their label columns."""
        return (self.sdf, self.index_columns) if self.index_columns else (self.positioned(), [POS])

    # projection and filters
    @property
    def columns(self) -> list[str]:
        return list(self._columns)

    @property
    def index(self) -> DataFrame:
        sdf, names = self.labelled()
        return sdf.select(*names)

    def __getitem__(self, key):
        if isinstance(key, str):
            if key not in self._columns:
                raise KeyError(key)
            return Series(self, F.col(f"`{key}`"), key)
        if isinstance(key, (list, tuple)) and all(isinstance(k, str) for k in key):
            if gone := [k for k in key if k not in self._columns]:
                raise KeyError(gone)
            return self._with(self.sdf, key)
        if isinstance(key, slice):
            return self.slice(key.start, key.stop, key.step)
        if isinstance(key, Series):
            return self.filter(key)
        if isinstance(key, Column):
            return self._with(self.sdf.where(key))
        if isinstance(key, (list, tuple)):
            return self.filter_by_position(key)
        raise TypeError(f"no selection by {type(key).__name__}")

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self.__dict__.get("_columns", ()):
            raise AttributeError(name)
        return self[name]

    def __len__(self) -> int:
        return self.sdf.count()

    def length(self) -> DataFrame:
        return self.sdf.agg(F.count("*").alias("length"))

    def filter(self, mask: Series) -> Frame:
        """Rows where the mask holds; a mask of another frame is brought by label, and each label must be in it once."""
        if mask.frame.lineage == self.lineage:
            return self._with(self.sdf.where(mask.expr))
        from .operators.align import reindexed

        return self._with(reindexed(self, mask, "__mask").where("__mask").drop("__mask"))

    def filter_by_position(self, mask: Iterable[bool]) -> Frame:
        flags = F.array(*[F.lit(bool(m)) for m in mask])
        return self._with(self.positioned().where(F.coalesce(F.get(flags, F.col(POS)), F.lit(False))))

    def slice(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> Frame:
        """Rows by position, with Python's meaning of negative bounds; the step must be positive."""
        step = step or 1
        if step < 1:
            raise ValueError("the step must be positive")
        sdf = self.positioned()
        bounds = [b for b in (start, stop) if b is not None and b < 0]
        n = sdf.count() if bounds else 0
        low = 0 if start is None else max(0, start + n) if start < 0 else start
        cond = F.col(POS) >= low
        if stop is not None:
            cond &= F.col(POS) < (max(0, stop + n) if stop < 0 else stop)
        return self._with(sdf.where(cond & ((F.col(POS) - low) % step == 0)))

    def head(self, n: int = 5) -> Frame:
        if n < 0:
            return self.slice(None, n)
        return self._with(self.sdf.orderBy(*self.order).limit(n))

    @property
    def loc(self) -> _Loc:
        return _Loc(self)

    @property
    def at(self) -> _At:
        return _At(self)

    @property
    def iloc(self) -> _ILoc:
        return _ILoc(self)

    @property
    def iat(self) -> _IAt:
        return _IAt(self)

    def take(self, places: list[int]) -> Frame:
        """Rows at these positions, in this order, repeats included; negative positions count from the end."""
        n = self.sdf.count() if any(p < 0 for p in places) else 0
        wanted = self.sdf.sparkSession.createDataFrame([(i, p + n if p < 0 else p) for i, p in enumerate(places)], f"__nth long, {POS} long")
        return self._with(self.positioned().join(F.broadcast(wanted), POS), order=["__nth"], by=[])

    def set_column(self, name: str, value) -> Frame:
        """A frame with the column added or replaced; a Series of another frame comes by label."""
        columns = [*self._columns, *([] if name in self._columns else [name])]
        if isinstance(value, Series) and value.frame.lineage != self.lineage:
            from .operators.align import reindexed

            return self._with(reindexed(self, value, "__new", strict=False).withColumn(name, F.col("__new")).drop("__new"), columns)
        expr = value.expr if isinstance(value, Series) else value if isinstance(value, Column) else F.lit(value)
        return self._with(self.sdf.withColumn(name, expr), columns)

    def drop(self, columns: str | Iterable[str], errors: str = "raise") -> Frame:
        names = [columns] if isinstance(columns, str) else list(columns)
        if errors == "raise" and (gone := [c for c in names if c not in self._columns]):
            raise KeyError(gone)
        return self._with(self.sdf, [c for c in self._columns if c not in names])

    def copy(self, deep: bool = True) -> Frame:
        return self

    def rename(self, columns: dict[str, str]) -> Frame:
        return self._with(self.sdf.withColumnsRenamed(columns), [columns.get(c, c) for c in self._columns], order=[columns.get(c, c) for c in self.order], by=[columns.get(c, c) for c in self.by])

    def values(self, name: str = "values") -> DataFrame:
        """Each row's numbers as an array of doubles."""
        return self.sdf.select(F.array(*[F.col(f"`{c}`").cast("double") for c in self._columns]).alias(name))

    def reset_index(self, drop: bool = False) -> Frame:
        sdf, labels = self.labelled()
        if drop:
            return Frame(sdf, self._columns, order=self.order, by=self.by)
        names = ["index"] if len(labels) == 1 else [f"level_{i}" for i in range(len(labels))]
        return Frame(sdf.withColumns({n: F.col(c) for n, c in zip(names, labels, strict=True)}), [*names, *self._columns], order=self.order, by=self.by)

    def set_index(self, *names: str) -> Frame:
        return self._with(self.sdf, [c for c in self._columns if c not in names], index=names)

    def each(self, f: Callable[[Column], Column]) -> Frame:
        """A frame with ``f`` of each data column."""
        return self._with(self.sdf.withColumns({c: f(F.col(f"`{c}`")) for c in self._columns}))

    def isna(self) -> Frame:
        return self.each(lambda c: c.isNull())

    def notna(self) -> Frame:
        return self.each(lambda c: c.isNotNull())

    def fillna(self, value) -> Frame:
        return self._with(self.sdf.na.fill(value, None if isinstance(value, dict) else self._columns))

    def dropna(self, how: str = "any", subset: list[str] | None = None) -> Frame:
        return self._with(self.sdf.na.drop(how, subset=subset or self._columns))

    def isin(self, values) -> Frame:
        from .operators.align import frame_isin

        return frame_isin(self, values)

    # reductions, groups, windows
    def reduce(self, name: str, **options) -> DataFrame:
        from .operators.reduce import frame_reduce

        return frame_reduce(self, name, **options)

    def groupby(self, by: str | list[str], sort: bool = True, as_index: bool = True):
        from .operators.group import GroupBy

        return GroupBy(self, [by] if isinstance(by, str) else list(by), sort=sort, as_index=as_index)

    def rolling(self, window: int | str, min_periods: int | None = None, center: bool = False, on: str | None = None):
        from .operators.rolling import Rolling

        return Rolling(self, window, min_periods, center, on)

    def describe(self, percentiles: list[float] | None = None) -> DataFrame:
        from .operators.reduce import describe

        return describe(self, percentiles)

    def pct_change(self, periods: int = 1, fill_method: str | None = "pad", undefined: float | None = None) -> Frame:
        from .operators.analytic import pct_change

        return pct_change(self, periods, fill_method, undefined)

    def append(self, other: Frame | list[Frame], ignore_index: bool = False) -> Frame:
        from .operators.setops import append

        return append(self, other, ignore_index)

    def merge(self, other: Frame, **how) -> Frame:
        from .operators.joins import merge

        return merge(self, other, **how)

    def pivot_table(self, index: str | list[str], columns: str, values: str, aggfunc: str = "mean", names: list | None = None) -> Frame:
        from .operators.group import pivot_table

        return pivot_table(self, index, columns, values, aggfunc, names)

    def sort_values(self, by: str | list[str], ascending: bool | list[bool] = True, na_position: str = "last") -> Frame:
        from .operators.sort import sort_values

        return sort_values(self, by, ascending, na_position)

    def sort_index(self, ascending: bool = True) -> Frame:
        from .operators.sort import sort_values

        return sort_values(self, self.index_columns, ascending)

    def apply(self, function: Callable, returns: str) -> Series:
        """``function`` of each row, as a pandas Series of the data columns, by Arrow batches; an expression is to be preferred."""
        from .functions.udf import row_function

        return Series(self, row_function(function, returns, self._columns), None)

    # sinks
    def spark(self) -> DataFrame:
        """Index and data columns, in order if there is one."""
        names = [*self.index_columns, *[c for c in self._columns if c not in self.index_columns]]
        return self.sdf.select(*[F.col(f"`{c}`") for c in names])

    def to_pandas(self):
        """All rows on the driver: for tests and small results."""
        ordered = self.sdf.orderBy(*self.order) if self.order else self.sdf
        pdf = ordered.select(*[F.col(f"`{c}`") for c in [*self.index_columns, *self._columns]]).toPandas()
        return pdf.set_index(self.index_columns) if self.index_columns else pdf

    def itertuples(self):
        """Rows in order, a partition at a time."""
        ordered = self.sdf.orderBy(*self.order) if self.order else self.sdf
        return ordered.select(*[F.col(f"`{c}`") for c in [*self.index_columns, *self._columns]]).toLocalIterator()


class _Loc:
    def __init__(self, frame: Frame):
        self.frame = frame

    def __getitem__(self, label) -> Frame:
        sdf, names = self.frame.labelled()
        if isinstance(label, slice):
            cond = F.lit(True)
            if label.start is not None:
                cond &= F.col(names[0]) >= F.lit(label.start)
            if label.stop is not None:
                cond &= F.col(names[0]) <= F.lit(label.stop)
            return self.frame._with(sdf.where(cond))
        if isinstance(label, list):
            wanted = sdf.sparkSession.createDataFrame([(i, x) for i, x in enumerate(label)], f"__nth long, __label {sdf.schema[names[0]].dataType.simpleString()}")
            return self.frame._with(sdf.join(F.broadcast(wanted), F.col(names[0]) == F.col("__label")).drop("__label"), order=["__nth", *self.frame.order])
        values = label if isinstance(label, tuple) else (label,)
        cond = F.lit(True)
        for n, v in zip(names, values, strict=False):
            cond &= F.col(n) == F.lit(v)
        return self.frame._with(sdf.where(cond))


class _At:
    def __init__(self, frame: Frame):
        self.frame = frame

    def __getitem__(self, key) -> DataFrame:
        """All values with the label."""
        label, column = key
        return self.frame.loc[label].sdf.select(F.col(f"`{column}`"))


class _ILoc:
    def __init__(self, frame: Frame):
        self.frame = frame

    def __getitem__(self, key) -> Frame:
        if callable(key):
            key = key(self.frame)
        if isinstance(key, tuple) and len(key) == 2 and not isinstance(key[0], bool):
            return self[key[0]]._with(self[key[0]].sdf, [self.frame.columns[key[1]]])
        if isinstance(key, slice):
            return self.frame.slice(key.start, key.stop, key.step)
        if isinstance(key, (list, tuple)):
            return self.frame.filter_by_position(key) if key and isinstance(key[0], bool) else self.frame.take(list(key))
        return self.frame.take([key])


class _IAt:
    def __init__(self, frame: Frame):
        self.frame = frame

    def __getitem__(self, key):
        """One value; out of bounds raises."""
        row, column = key
        found = self.frame.take([row]).sdf.select(F.col(f"`{self.frame.columns[column]}`")).first()
        if found is None:
            raise IndexError(row)
        return found[0]


class _Str:
    """The string functions of a Series."""

    def __init__(self, series: Series):
        self._series = series

    def len(self) -> Series:
        return self._series._map(strings.length)

    def __getattr__(self, name: str):
        if name not in strings.NAMES:
            raise AttributeError(name)
        return lambda *a, **k: self._series._map(lambda c: getattr(strings, name)(c, *a, **k))


class _Dt:
    def __init__(self, series: Series):
        self._series = series

    def __getattr__(self, name: str) -> Series:
        if name not in temporal.FIELDS:
            raise AttributeError(name)
        return self._series._map(lambda c: temporal.field(c, name))


class Series:
    """A column expression over a Frame."""

    def __init__(self, frame: Frame, expr: Column, name: str | None):
        self.frame, self.expr, self.name = frame, expr, name

    def _map(self, f: Callable[[Column], Column], name: str | None = "") -> Series:
        return Series(self.frame, f(self.expr), self.name if name == "" else name)

    def to_frame(self, name: str | None = None) -> Frame:
        name = name or self.name or "value"
        return self.frame._with(self.frame.sdf.withColumn(name, self.expr), [name])

    def spark(self, name: str | None = None) -> DataFrame:
        return self.to_frame(name).spark()

    def _operate(self, other, f: Callable[[Column, Column], Column], fill=None, strict: bool = False) -> Series:
        fill = None if fill is None else F.lit(fill)
        if not isinstance(other, Series):
            a, b = with_fill(self.expr, other if isinstance(other, Column) else F.lit(other), fill)
            return Series(self.frame, f(a, b), self.name)
        if other.frame.lineage == self.frame.lineage:
            a, b = with_fill(self.expr, other.expr, fill)
            return Series(self.frame, f(a, b), None)
        from .operators.align import aligned

        both = aligned(self, other, strict)
        a, b = with_fill(F.col("__left"), F.col("__right"), fill)
        return Series(both, f(a, b), None)

    def _compare(self, other, f, fill=None) -> Series:
        return self._operate(other, f, fill, strict=True)

    @property
    def str(self) -> _Str:
        return _Str(self)

    @property
    def dt(self) -> _Dt:
        return _Dt(self)

    @property
    def values(self) -> DataFrame:
        return self.frame.sdf.select(self.expr.alias(self.name or "value"))

    @property
    def index(self) -> DataFrame:
        return self.frame.index

    @property
    def T(self) -> Series:  # noqa: N802
        return self

    ndim = 1

    @property
    def size(self) -> int:
        return len(self.frame)

    @property
    def shape(self) -> tuple[int]:
        return (len(self.frame),)

    def __len__(self) -> int:
        return len(self.frame)

    def __getitem__(self, key) -> Series:
        frame = self.to_frame()
        if isinstance(key, slice):
            frame = frame.slice(key.start, key.stop, key.step)
        elif isinstance(key, Series):
            same = Series(frame, key.expr, key.name) if key.frame.lineage == self.frame.lineage else key
            frame = frame.filter(same)
        elif isinstance(key, list):
            frame = frame.filter_by_position(key) if key and isinstance(key[0], bool) else frame.loc[key]
        else:
            frame = frame.loc[key]
        return frame[frame.columns[0]]

    def where_set(self, condition: Series | Column, value) -> Series:
        """The series with ``value`` where the condition holds: assignment without mutation."""
        cond = condition.expr if isinstance(condition, Series) else condition
        new = value.expr if isinstance(value, Series) else value if isinstance(value, Column) else F.lit(value)
        return self._map(lambda c: F.when(F.coalesce(cond, F.lit(False)), new).otherwise(c))

    @property
    def iloc(self) -> _Of:
        return _Of(self, "iloc")

    @property
    def loc(self) -> _Of:
        return _Of(self, "loc")

    @property
    def iat(self) -> _Of:
        return _Of(self, "iat")

    @property
    def at(self) -> _Of:
        return _Of(self, "at")

    def head(self, n: int = 5) -> Series:
        frame = self.to_frame().head(n)
        return frame[frame.columns[0]]

    def take(self, places: list[int]) -> Series:
        frame = self.to_frame().take(places)
        return frame[frame.columns[0]]

    def rename(self, name: str) -> Series:
        return Series(self.frame, self.expr, name)

    def copy(self, deep: bool = True) -> Series:
        return self

    def astype(self, kind: str, errors: str = "raise") -> Series:
        """Cast to a Spark type; text that is no number raises, or with ``errors='ignore'`` leaves the series as it is."""
        if errors == "ignore" and dict(self.to_frame("__c").sdf.dtypes)["__c"] == "string" and kind != "string":
            return self
        return self._map(lambda c: c.cast(kind))

    def isin(self, values: Iterable) -> Series:
        values = [v for v in values if v is not None]
        return self._map(lambda c: F.coalesce(c.isin(values), F.lit(False)) if values else F.lit(False))

    def isna(self) -> Series:
        return self._map(lambda c: c.isNull())

    isnull = isna

    def notna(self) -> Series:
        return self._map(lambda c: c.isNotNull())

    def dropna(self) -> Series:
        frame = self.to_frame()
        frame = frame._with(frame.sdf.where(F.col(f"`{frame.columns[0]}`").isNotNull()))
        return frame[frame.columns[0]]

    def fillna(self, value) -> Series:
        return self._map(lambda c: F.coalesce(c, F.lit(value)))

    def abs(self) -> Series:
        return self._map(F.abs)

    def map(self, how, returns: str | None = None) -> Series:
        """By a dictionary (missing: NULL), by a function from Column to Column, or, with ``returns``, by a Python function of a value."""
        from .functions.udf import lookup, value_function

        if isinstance(how, dict):
            return self._map(lambda c: lookup(c, how))
        return self._map(value_function(how, returns) if returns else how)

    apply = map

    def concat_text(self, other) -> Series:
        return self._operate(other, F.concat)

    def repeat_text(self, other) -> Series:
        return self._operate(other, lambda a, n: F.repeat(a, F.greatest(F.lit(0), n).cast("int")))

    # ordered operations give frames: without a partition key they work on buckets
    def shift(self, periods: int = 1, fill_value=None) -> Series:
        from .operators.analytic import shift

        return shift(self, periods, fill_value)

    def cumsum(self, skipna: bool = True) -> Series:
        from .operators.analytic import cumsum

        return cumsum(self, skipna)

    def pct_change(self, periods: int = 1, fill_method: str | None = "pad") -> Series:
        from .operators.analytic import pct_change

        frame = pct_change(self.to_frame(), periods, fill_method)
        return frame[frame.columns[0]]

    def argsort(self) -> Series:
        from .operators.sort import argsort

        return argsort(self)

    def sort_values(self, ascending: bool = True, na_position: str = "last") -> Series:
        frame = self.to_frame()
        frame = frame.sort_values(frame.columns[0], ascending, na_position)
        return frame[frame.columns[0]]

    def nlargest(self, n: int = 5) -> Series:
        from .operators.sort import extremes

        return extremes(self, n, largest=True)

    def nsmallest(self, n: int = 5) -> Series:
        from .operators.sort import extremes

        return extremes(self, n, largest=False)

    def append(self, other: Series | list[Series], ignore_index: bool = False) -> Series:
        name = self.name or "value"
        others = [o.to_frame(name) for o in (other if isinstance(other, list) else [other])]
        frame = self.to_frame(name).append(others, ignore_index)
        return frame[name]

    def rolling(self, window: int | str, min_periods: int | None = None, center: bool = False, on: str | None = None):
        return self.to_frame().rolling(window, min_periods, center, on)

    def groupby(self, by: Series | list[str] | str, sort: bool = True):
        name = self.name or "value"
        if isinstance(by, Series):
            frame = self.frame._with(self.frame.sdf.withColumns({name: self.expr, "__key": by.expr}), [name, "__key"])
            return frame.groupby("__key", sort)[name]
        return self.frame._with(self.frame.sdf.withColumn(name, self.expr), list(dict.fromkeys([name, *([by] if isinstance(by, str) else by)]))).groupby(by, sort)[name]

    # reductions are one-row frames
    def reduce(self, name: str, alias: str | None = None, **options) -> DataFrame:
        from .operators.reduce import reduction

        if name == "median":
            return self.quantile(0.5, alias or name, **options)
        return self.frame.sdf.agg(reduction(name, self.expr, **options).alias(alias or name))

    def quantile(self, q: float | list[float] = 0.5, alias: str = "quantile", skipna: bool = True) -> DataFrame:
        from .operators.reduce import quantiles

        many = isinstance(q, list)
        found = quantiles(self.frame.sdf, {alias: self.expr}, q if many else [q], skipna)
        return found if many else found.select(F.col(f"`{alias}`")[0].alias(alias))

    def cov(self, other: Series, min_periods: int = 2, alias: str = "cov") -> DataFrame:
        from .operators.reduce import pairwise

        return pairwise(self, other, "cov", max(2, min_periods), alias)

    def corr(self, other: Series, min_periods: int = 1, alias: str = "corr") -> DataFrame:
        from .operators.reduce import pairwise

        return pairwise(self, other, "corr", max(1, min_periods), alias)

    def idxmax(self) -> DataFrame:
        from .operators.reduce import extreme_label

        return extreme_label(self, largest=True)

    def idxmin(self) -> DataFrame:
        from .operators.reduce import extreme_label

        return extreme_label(self, largest=False)

    def unique(self) -> DataFrame:
        return self.values.distinct()

    def value_counts(self, sort: bool = True, ascending: bool = False, dropna: bool = True) -> DataFrame:
        from .operators.reduce import value_counts

        return value_counts(self, sort, ascending, dropna)

    def describe(self, percentiles: list[float] | None = None) -> DataFrame:
        from .operators.reduce import describe

        return describe(self.to_frame(), percentiles)


class _Of:
    """An accessor of a frame of one column, as series."""

    def __init__(self, series: Series, accessor: str):
        self.series, self.accessor = series, accessor

    def __getitem__(self, key):
        frame = self.series.to_frame()
        name = frame.columns[0]
        if self.accessor == "iat":
            return frame.iat[key, 0]
        if self.accessor == "at":
            return frame.at[key, name]
        if callable(key) and self.accessor == "iloc":
            key = key(self.series)
        found = getattr(frame, self.accessor)[key]
        return found[name]


def _method(name: str, f, compare: bool):
    def method(self: Series, other, fill_value=None) -> Series:
        return self._compare(other, f, fill_value) if compare else self._operate(other, f, fill_value)

    method.__name__ = name
    return method


for _name, _f in {**ARITHMETIC, **COMPARISON}.items():
    setattr(Series, _name, _method(_name, _f, _name in COMPARISON))


def _operator(name: str):
    return lambda self, other: getattr(self, name)(other)


for _name in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "lt", "gt", "le", "ge", "ne", "eq"):
    setattr(Series, f"__{_name}__", _operator(_name))
for _name in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow"):
    setattr(Series, f"__r{_name}__", (lambda n: lambda self, other: Series(self.frame, ARITHMETIC[n](F.lit(other), self.expr), self.name))(_name))
Series.__and__ = lambda self, other: self._operate(other, lambda a, b: a & b)
Series.__or__ = lambda self, other: self._operate(other, lambda a, b: a | b)
Series.__invert__ = lambda self: self._map(lambda c: ~c)
for _name in ("sum", "prod", "mean", "median", "min", "max", "std", "var", "skew", "count", "nunique"):
    setattr(Series, _name, (lambda n: lambda self, **options: self.reduce(n, **options))(_name))
for _name in ("sum", "prod", "mean", "median", "min", "max", "std", "var", "count"):
    setattr(Frame, _name, (lambda n: lambda self, **options: self.reduce(n, **options))(_name))
