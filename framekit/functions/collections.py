"""Maps for dictionaries, arrays for sets, codes for categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_of(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def map_from(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


def map_from_keys(keys: Column, value: Column) -> Column:
    return F.map_from_arrays(keys, F.transform(keys, lambda _: value))


def map_get(m: Column, key: Column, default: Column | None = None) -> Column:
    found = F.try_element_at(m, key)
    return F.when(F.map_contains_key(m, key), found).otherwise(default) if default is not None else found


def map_set(m: Column, key: Column, value: Column) -> Column:
    return map_update(m, F.create_map(key, value))


def map_update(m: Column, other: Column) -> Column:
    """The entries of both; ``other`` wins."""
    return F.map_concat(F.map_filter(m, lambda k, v: ~F.array_contains(F.map_keys(other), k)), other)


def map_pop(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def set_add(s: Column, value: Column) -> Column:
    return F.array_union(s, F.array(value))


def set_contains(s: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(s, value), F.lit(False))


def to_codes(c: Column, categories: list) -> Column:
    """A category's place in ``categories``; -1 for values that are none, and for NULL."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, categories)), c).cast("int") - 1, F.lit(-1))


def from_codes(codes: Column, categories: list) -> Column:
    return F.when(codes >= 0, F.get(F.array(*map(F.lit, categories)), codes))


def as_category(sdf: DataFrame, column: str, categories: list, ordered: bool = False) -> DataFrame:
    """``column`` as codes, with the categories in the column's metadata."""
    return sdf.withColumn(column, to_codes(F.col(column), categories).alias(column, metadata={"categories": categories, "ordered": ordered}))


def categories_of(sdf: DataFrame, column: str) -> tuple[list, bool]:
    meta = sdf.schema[column].metadata
    return meta["categories"], meta["ordered"]
