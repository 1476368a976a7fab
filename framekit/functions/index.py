"""Index values as columns: ranges, label arrays and several levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import POS, positions


def range_index(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "index") -> DataFrame:
    return spark.range(start, stop, step).select(F.col("id").alias(name))


def contains(index: DataFrame, label, name: str = "contains") -> DataFrame:
    return index.agg(F.coalesce(F.bool_or(F.col(index.columns[0]) == F.lit(label)), F.lit(False)).alias(name))


def equals(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], name: str = "equals") -> DataFrame:
    """Whether both have the same labels at the same positions."""
    x = positions(a, order_a).select(POS, F.struct(*a.columns).alias("x"))
    y = positions(b, order_b).select(POS, F.struct(*b.columns).alias("y"))
    both = x.join(y, POS, "full")
    return both.agg(F.coalesce(F.bool_and(F.coalesce(F.col("x") == F.col("y"), F.lit(False))), F.lit(True)).alias(name))


def reindex(index: DataFrame, order: list[str], target: DataFrame, name: str = "indexer") -> DataFrame:
    """For each target label its position in the index, -1 if it isn't there."""
    label, own = target.columns[0], index.columns[0]
    placed = positions(index, order).select(F.col(own).alias("__l"), POS)
    return target.join(placed, F.col(label) == F.col("__l"), "left").select(label, F.coalesce(POS, F.lit(-1)).alias(name))


def from_product(levels: list[tuple[str, DataFrame]]) -> DataFrame:
    """All combinations of the levels' labels: their number is the product by definition."""
    out = None
    for name, labels in levels:
        one = labels.select(F.col(labels.columns[0]).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Each label's number among the sorted distinct labels of its level; -1 for missing labels."""
    labels = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbered = positions(labels, [column]).select(F.col(column).alias("__l"), F.col(POS).alias(name))
    return df.join(numbered, F.col(column) == F.col("__l"), "left").drop("__l").withColumn(name, F.coalesce(name, F.lit(-1)))


def take(index: DataFrame, order: list[str], places: DataFrame, at: str = "at") -> DataFrame:
    """The labels at the positions that ``places`` lists in its first column, beside these (``at``); negative ones count from the end."""
    placed = positions(index, order)
    n = index.agg(F.count("*").alias("__n"))
    wanted = places.select(F.col(places.columns[0]).cast("long").alias(at)).join(F.broadcast(n)).withColumn("__p", F.when(F.col(at) < 0, F.col(at) + F.col("__n")).otherwise(F.col(at)))
    return wanted.join(placed, F.col("__p") == F.col(POS)).select(at, *index.columns)


def append(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], name: str = "position") -> DataFrame:
    """The labels of ``a`` and then those of ``b``, with their positions."""
    parts = [positions(x, order).select(F.lit(i).alias("__i"), F.col(POS).alias("__p"), F.col(x.columns[0]).alias(a.columns[0])) for i, (x, order) in enumerate(((a, order_a), (b, order_b)))]
    return positions(parts[0].unionByName(parts[1]), ["__i", "__p"]).select(F.col(POS).alias(name), a.columns[0])


def join(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], how: str = "outer") -> DataFrame:
    """The joint labels with their positions in ``a`` (left) and ``b`` (right), -1 where there is none."""
    label = a.columns[0]
    x = positions(a, order_a).select(F.col(label), F.col(POS).alias("left"))
    y = positions(b, order_b).select(F.col(b.columns[0]).alias(label), F.col(POS).alias("right"))
    return x.join(y, label, how).select(label, F.coalesce("left", F.lit(-1)).alias("left"), F.coalesce("right", F.lit(-1)).alias("right"))


def compare(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str], name: str = "eq") -> DataFrame:
    """Whether the labels at each position are equal; both have to be of one length."""
    x, y = (positions(i, o).select(F.col(POS), F.col(i.columns[0]).alias(n)) for i, o, n in ((a, order_a, "__a"), (b, order_b, "__b")))
    both = x.join(y, POS, "full")
    same = F.when(F.col("__a").isNull() & F.col("__b").isNull(), False).otherwise(F.coalesce(F.col("__a") == F.col("__b"), F.lit(False)))
    return both.select(F.col(POS).alias("position"), same.alias(name))


def from_tuples(spark: SparkSession, tuples: list[tuple], names: list[str]) -> DataFrame:
    """An index of several levels from a list of its labels, with their positions."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(tuples)], ["position", *names])


def levels(index: DataFrame, column: str) -> DataFrame:
    """The sorted distinct labels of a level, with their numbers."""
    return positions(index.select(column).where(F.col(column).isNotNull()).distinct(), [column]).select(F.col(POS).alias("code"), column)
