"""Rolling windows over rows or over time.

A window is the last N rows (with ``center``, N around the row) or the rows of the last span before a row's time, which is
part of it. Values that aren't finite are left out; fewer than ``min_periods`` of them give NULL. A frame without partition
key is worked on in buckets with a halo, so that no window runs in one task for all rows. Windows of time are put together from two growing
windows (``Stretches``), so that a row costs the same however many rows its span holds; quantiles, skew, kurt, ``apply`` and counts with
``min_periods`` above 1 still look at each row of each span.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.missing import finite
from ..functions.temporal import micros
from .ordering import POS, with_halo

if TYPE_CHECKING:
    from ..frame import Frame

_UNITS = {"us": 1, "ms": 1000, "s": 10**6, "min": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6}

#: Up to so many rows a window is given to a Python function as an array made for each row.
ARRAY_ROWS = 256


def microseconds(span: str) -> int:
    number, unit = re.fullmatch(r"(\d*)\s*([a-zA-Z]+)", span).groups()
    unit = {"t": "min", "S": "s", "sec": "s", "H": "h", "D": "d", "l": "ms", "u": "us"}.get(unit, unit.lower())
    return int(number or 1) * _UNITS[unit]


class Stretches:
    """The rows in a span of time before each row, without going through them again for each.

    Time is cut in stretches as long as the span. A span holds the rows of its own stretch up to its end (``now``) and those of the stretch
    before it from some time on (``before``): two windows that only grow, the second one backwards. Their aggregates are merged; nothing is subtracted.
    """

    def __init__(self, now: WindowSpec, before: WindowSpec, own: Column):
        self.now, self.before, self.own = now, before, own

    def _parts(self, kind: str, *cs: Column) -> tuple[Column, Column]:
        f = getattr(F, kind)
        return f(*[F.when(~self.own, c) for c in cs]).over(self.before), f(*[F.when(self.own, c) for c in cs]).over(self.now)

    def of(self, kind: str, *cs: Column) -> Column:
        if kind in ("count", "sum", "min", "max"):
            a, b = self._parts(kind, *cs)
            return {"count": lambda: a + b, "sum": lambda: F.coalesce(a + b, a, b), "min": lambda: F.least(a, b), "max": lambda: F.greatest(a, b)}[kind]()
        na, nb = self._parts("count", cs[0])
        n = F.when(na + nb > 0, na + nb)
        if kind == "avg":
            return self.of("sum", *cs) / n
        if kind == "var_samp":
            return self.of("var_pop", *cs) * n / F.when(n > 1, n - 1)
        a, b = self._parts(kind, *cs)  # var_pop, covar_pop
        (xa, xb), (ya, yb) = self._parts("avg", cs[0]), self._parts("avg", cs[-1])
        return F.coalesce((a * na + b * nb + (xa - xb) * (ya - yb) * na * nb / n) / n, a, b)


def over(w: WindowSpec | Stretches, kind: str, *cs: Column) -> Column:
    return w.of(kind, *cs) if isinstance(w, Stretches) else getattr(F, kind)(*cs).over(w)


class Rolling:
    def __init__(self, frame: Frame, window: int | str, min_periods: int | None = None, center: bool = False, on: str | None = None, selected: list[str] | None = None):
        self.timed = isinstance(window, str)
        if not self.timed and window < 0:
            raise ValueError("the window must not be negative")
        if self.timed and (not on or center):
            raise ValueError("a time window needs the time column in `on`, and no center")
        self.size = microseconds(window) if self.timed else window
        self.least = (1 if self.timed else window) if min_periods is None else min_periods
        if self.least < 0 or not self.timed and self.least > window:
            raise ValueError("min_periods must be between 0 and the window")
        self.frame, self.window, self.center, self.on, self.selected = frame, window, center, on, selected

    def __getitem__(self, key: str | list[str]) -> Rolling:
        return Rolling(self.frame, self.window, self.least, self.center, self.on, [key] if isinstance(key, str) else list(key))

    @property
    def columns(self) -> list[str]:
        kinds = dict(self.frame.sdf.dtypes)
        return self.selected or [c for c in self.frame.columns if c != self.on and re.match("tinyint|smallint|int|bigint|float|double|decimal", kinds[c])]

    def _bounds(self) -> tuple[int, int]:
        ahead = self.size - 1 - self.size // 2 if self.center else 0
        return -(self.size - 1) + ahead, ahead

    def over(self, made: dict[str, Callable[[WindowSpec | Stretches, WindowSpec | None], Column]], sliding: bool = False) -> Frame:
        """The frame with these columns; each is given the window and the rows up to this one. Windows of time are ``Stretches`` unless ``sliding``."""
        frame, by = self.frame, self.frame.by
        sdf, order, own = frame.sdf, frame.order, None
        if self.timed:
            time = micros(F.col(self.on))
            if not by or not sliding:  # a window's rows lie in its own stretch of time, as long as the window, and the one before
                home = F.floor((time - F.pmod(time, F.lit(self.size))) / self.size)
                sdf = sdf.withColumn("__bucket", F.explode(F.array_distinct(F.array(home, home + 1)))).withColumn("__own", F.col("__bucket").eqNullSafe(home))
                by, own = [*by, "__bucket"], "__own"
            whole = Window.partitionBy(*by).orderBy(time)
            w, up = whole.rangeBetween(-(self.size - 1), 0), whole.rangeBetween(Window.unboundedPreceding, 0)
            if not sliding:  # the stretch before is moved ahead, so that a row is in the spans of all times up to its key
                key, grows = F.when(F.col(own), time).otherwise(time + self.size - 1), (Window.unboundedPreceding, Window.currentRow)
                parts = Window.partitionBy(*by)
                w, up = Stretches(parts.orderBy(key).rangeBetween(*grows), parts.orderBy(key.desc()).rangeBetween(*grows), F.col(own)), None
        else:
            low, high = self._bounds()
            if not by:
                sdf = with_halo(sdf.drop(POS), order, max(0, -low), high)
                by, order, own = ["__bucket"], [POS], "__own"
            whole = Window.partitionBy(*by).orderBy(*order)
            w, up = whole.rowsBetween(low, high), whole.rowsBetween(Window.unboundedPreceding, 0)
            if not self.size:
                w = None
        out = sdf.withColumns({n: f(w, up) if w is not None else f(None, up) for n, f in made.items()})
        if own:
            out = out.where(own).drop("__own", "__bucket")
        return frame._with(out, list(made))

    def _guarded(self, c: Column, value: Callable[[Column, WindowSpec], Column], least: int = 1, empty: Column | None = None, clean: bool = False) -> Callable:
        """``clean``: the value is never NaN and is not to be named twice, as each naming of a Python window function runs it."""
        c = finite(c)

        def of(w: WindowSpec | Stretches | None, _: WindowSpec | None) -> Column:
            n = over(w, "count", c) if w is not None else F.lit(0)
            enough = n >= max(self.least, least if empty is None else 0)
            if w is None:
                return F.when(enough, empty) if empty is not None else F.lit(None).cast("double")
            found = value(c, w)
            return F.when(enough, found) if clean else F.when(enough, F.coalesce(found, empty) if empty is not None else F.when(~F.isnan(found), found))

        return of

    def _each(self, value: Callable[[Column, WindowSpec], Column], least: int = 1, empty: Column | None = None, sliding: bool = False) -> Frame:
        return self.over({c: self._guarded(F.col(f"`{c}`"), value, least, empty) for c in self.columns}, sliding)

    def sum(self) -> Frame:
        return self._each(lambda c, w: over(w, "sum", c), empty=F.lit(0.0))

    def mean(self) -> Frame:
        return self._each(lambda c, w: over(w, "avg", c))

    def min(self) -> Frame:
        return self._each(lambda c, w: over(w, "min", c))

    def max(self) -> Frame:
        return self._each(lambda c, w: over(w, "max", c))

    def median(self) -> Frame:
        return self.quantile(0.5)

    def quantile(self, q: float) -> Frame:
        if not 0 <= q <= 1:
            raise ValueError("q must be between 0 and 1")
        return self._each(lambda c, w: F.percentile(c, F.lit(q)).over(w), sliding=True)

    def count(self) -> Frame:
        """Known values (infinite ones too), once ``min_periods`` rows are there."""

        def of(c: Column) -> Callable:
            enough = lambda up: F.lit(True) if up is None else F.count(F.lit(1)).over(up) >= self.least
            return lambda w, up: F.when(enough(up), over(w, "count", c).cast("double") if w is not None else F.lit(0.0))

        return self.over({c: of(F.col(f"`{c}`")) for c in self.columns}, sliding=self.least > 1)

    def _variance(self, ddof: int, root: bool) -> Frame:
        def of(c: Column, w: WindowSpec) -> Column:
            n = over(w, "count", c)
            v = over(w, "var_samp", c) if ddof == 1 else F.when(n > ddof, over(w, "var_pop", c) * n / F.when(n > ddof, n - ddof))
            return F.sqrt(v) if root else v

        return self._each(of)

    def var(self, ddof: int = 1) -> Frame:
        return self._variance(ddof, False)

    def std(self, ddof: int = 1) -> Frame:
        return self._variance(ddof, True)

    def skew(self) -> Frame:
        def of(c: Column, w: WindowSpec) -> Column:
            n = F.count(c).over(w)
            flat = F.min(c).over(w) == F.max(c).over(w)
            return F.when(~flat & (n > 2), F.skewness(c).over(w) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))

        return self._each(of, 3, sliding=True)

    def kurt(self) -> Frame:
        def of(c: Column, w: WindowSpec) -> Column:
            n = F.count(c).over(w)
            flat = F.min(c).over(w) == F.max(c).over(w)
            adjusted = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c).over(w) + 6)
            return F.when(n > 3, F.when(flat, 0.0).otherwise(adjusted))

        return self._each(of, 4, sliding=True)

    def _paired(self, other, kind: str, ddof: int) -> Frame:
        """With a column (name) of this frame, or the columns of the same names in a frame that has the same rows."""
        names = self.columns if isinstance(other, str) else [c for c in self.columns if c in other.columns]

        def of(a: str) -> Callable:
            b = other if isinstance(other, str) else other[a].expr
            x, y = finite(F.col(f"`{a}`")), finite(F.col(b) if isinstance(b, str) else b)
            x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)

            def value(w: WindowSpec, _: WindowSpec) -> Column:
                n = over(w, "count", x)
                if kind == "corr":
                    spread = (over(w, "min", x) < over(w, "max", x)) & (over(w, "min", y) < over(w, "max", y))
                    scale = F.sqrt(over(w, "var_pop", x)) * F.sqrt(over(w, "var_pop", y))  # corr() itself raises without spread
                    return F.when((n >= max(self.least, 1)) & spread, over(w, "covar_pop", x, y) / F.when(scale > 0, scale))
                return F.when((n >= max(self.least, 1)) & (n > ddof), over(w, "covar_pop", x, y) * n / F.when(n > ddof, n - ddof))

            return value

        made = {c: of(c) for c in names}
        rest = [c for c in (list(dict.fromkeys([*self.columns, *other.columns])) if not isinstance(other, str) else []) if c not in names]
        made |= {c: lambda w, _: F.lit(None).cast("double") for c in rest}
        return self.over(made)

    def corr(self, other) -> Frame:
        return self._paired(other, "corr", 1)

    def cov(self, other, ddof: int = 1) -> Frame:
        return self._paired(other, "cov", ddof)

    def apply(self, function: Callable, returns: str = "double") -> Frame:
        """A Python function of the finite values of a window, as a pandas Series, by Arrow; a built-in is to be preferred."""
        from ..functions.udf import array_function, window_function

        if self.timed or self.size > ARRAY_ROWS:  # by sequences, each of them whole
            f = window_function(function, returns)
            return self.over({c: self._guarded(F.col(f"`{c}`"), lambda c, w: f(c).over(w), least=0, clean=True) for c in self.columns}, sliding=True)
        g = array_function(function, returns)  # by batches of rows with their windows: short sequences cost no batch each

        def of(c: Column) -> Callable:
            c = finite(c)

            def value(w: WindowSpec | None, _: WindowSpec) -> Column:
                return g(F.when(F.count(c).over(w) >= self.least, F.collect_list(c).over(w))) if w is not None else F.lit(None).cast("double")

            return value

        return self.over({c: of(F.col(f"`{c}`")) for c in self.columns})

    def agg(self, names: list[str]) -> Frame:
        """Several built-in functions at once, as column_function."""
        out = None
        for n in names:
            made = getattr(Rolling(self.frame, self.window, self.least, self.center, self.on, self.columns), n)()
            made = made.rename({c: f"{c}_{n}" for c in made.columns})
            keys = [*self.frame.by, *self.frame.order]
            out = made if out is None else out._with(out.sdf.join(made.sdf.select(*keys, *made.columns), keys), [*out.columns, *made.columns])
        return out
