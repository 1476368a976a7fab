"""User functions. A function from Column to Column stays in the JVM; Python functions get Arrow batches and a declared type."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: Up to so many entries a dictionary is a literal map in the plan.
LITERAL_MAP = 1000


def lookup(c: Column, values: dict) -> Column:
    """The value of each key; NULL for keys that aren't there."""
    if len(values) > LITERAL_MAP:
        raise ValueError("join with a table of the entries instead")
    return F.try_element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), c)


def value_function(function: Callable, returns: str) -> Callable[[Column], Column]:
    """Of each known value; missing values stay missing."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(function, na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returns)


def row_function(function: Callable, returns: str, columns: list[str]) -> Column:
    def run(rows: pd.DataFrame) -> pd.Series:
        return rows.apply(function, axis=1)

    run.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(run, returns)(F.struct(*[F.col(f"`{c}`") for c in columns]))


def group_function(function: Callable, returns: str) -> Callable[[Column], Column]:
    def run(s: pd.Series) -> float:
        return function(s)

    run.__annotations__ = {"s": pd.Series, "return": float}
    return F.pandas_udf(run, returns)


def window_function(function: Callable, returns: str) -> Callable[[Column], Column]:
    """Of the known values of each window, as a pandas Series. Windows are cut, and freed of missing values, in Arrow: pandas takes far longer for both."""
    kind = to_arrow_type(_parse_datatype_string(returns))
    labels: dict[int, pd.RangeIndex] = {}

    def run(window: pa.Array) -> pa.Scalar:
        held = (window.drop_null() if window.null_count else window).to_numpy(zero_copy_only=False).copy()
        n = len(held)
        if n not in labels:
            labels[n] = pd.RangeIndex(n)
        return pa.scalar(function(pd.Series(held, labels[n], copy=False)), kind, from_pandas=True)

    run.__annotations__ = {"window": pa.Array, "return": pa.Scalar}
    return F.arrow_udf(run, returns)


def array_function(function: Callable, returns: str) -> Callable[[Column], Column]:
    """Of the values in each array of doubles, as a pandas Series, by batches of rows; NULL where there is no array."""
    kind = to_arrow_type(_parse_datatype_string(returns))

    def run(arrays: pa.Array) -> pa.Array:
        known, out = arrays.is_valid().to_pylist(), []
        sizes = [n or 0 for n in pc.list_value_length(arrays).to_pylist()]
        held, at = arrays.flatten().to_numpy(zero_copy_only=False).copy(), 0
        labels = {n: pd.RangeIndex(n) for n in set(sizes)}
        for k, n in zip(known, sizes, strict=True):
            out.append(function(pd.Series(held[at : at + n], labels[n], copy=False)) if k else None)
            at += n
        return pa.array(out, kind, from_pandas=True)

    run.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)
