"""The registry that the catalog modules fill: query, SQL and the inventory rows that a query covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def add(name: str, rows: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """``rows``: inventory rows, as text."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name], COVERS[name] = query, rows
    if sql:
        ORACLES[name] = sql


#: events with v, which is value but missing where event_id divides by 7, and w, missing where it divides by 5.
EVENTS = "(SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 101 END AS w FROM events)"


def events(spark: SparkSession, d: str, by: tuple = ("user_id",)) -> Frame:
    sdf = spark.read.parquet(f"{d}/events.parquet")
    sdf = sdf.withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value"))).withColumn("w", F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 101))
    return Frame.of(sdf, index=["event_id"], order=["event_id"], by=by, columns=sdf.columns)


def load(spark: SparkSession, d: str, name: str, **keys) -> Frame:
    return Frame.of(spark.read.parquet(f"{d}/{name}.parquet"), **keys)


def half_away(c: Column, digits: int) -> Column:
    """c as SQL's round() of a double has it: c times the power of ten, as a double, to the nearest whole number, and back; a zero keeps its sign.

    Spark's round() takes the shortest decimal text of c instead, which differs where that product is a tie and the text is not, or the reverse.
    """
    r = F.round(c * float(10**digits), 0) / float(10**digits)
    return F.when(r == 0, c * 0.0).when(F.abs(r) < float("inf"), r).otherwise(c)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[half_away(F.col(f"`{c}`").cast("double"), digits).cast(kind).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes])
