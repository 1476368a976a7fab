"""Row order in parallel: positions and running sums by a two-phase scan, bounded windows by buckets with a halo.

A window without partition key runs in one task. The two shapes here replace it. The scan deals rows by ranges of the order key,
orders each range by itself and adds what the ranges before it hold, one row each. The halo puts positions in buckets and copies the
last rows of each bucket into the next, so that a bounded window sees all its rows inside one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..pinning import pin

POS, BUCKET_ROWS = "__pos", 65536


def ranged(sdf: DataFrame, order: list[str]) -> DataFrame:
    """``sdf``, written, with the number of the range of the order that a row lies in, in ``__part``."""
    n = int(sdf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pin(sdf.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))


def scan(sdf: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``sdf`` with, for each name, the running sum (this row included) of an expression over the order; missing counts 0."""
    dealt = ranged(sdf, order)
    totals = dealt.groupBy("__part").agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(f"__t_{n}") for n, e in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), "__part")
    out = out.withColumns({n: F.coalesce(F.sum(e).over(inside), F.lit(0)) + F.col(f"__o_{n}") for n, e in sums.items()})
    return out.drop("__part", *[f"__o_{n}" for n in sums])


def positions(sdf: DataFrame, order: list[str]) -> DataFrame:
    """``sdf`` with the 0-based position of each row in ``POS``."""
    return scan(sdf, order, {POS: F.lit(1).cast("long")}).withColumn(POS, F.col(POS) - 1)


def carry(sdf: DataFrame, order: list[str], column: str, name: str, back: bool = False) -> DataFrame:
    """``sdf`` with the last known value of ``column`` up to each row, over the whole order; with ``back`` the next known from each row on.

    The next is the last in reverse order: a window up to its end is gone through anew for each row, one from its start is not.
    """
    dealt, known = ranged(sdf, order), F.when(F.col(column).isNotNull(), F.struct(*order))
    pick, nearest, others = (F.min_by, F.first, (1, Window.unboundedFollowing)) if back else (F.max_by, F.last, (Window.unboundedPreceding, -1))
    along = [F.col(c).desc() for c in order] if back else order
    ends = dealt.groupBy("__part").agg(pick(F.when(F.col(column).isNotNull(), F.col(column)), known).alias("__end"))
    ends = ends.select("__part", nearest("__end", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(*others)).alias("__beyond"))
    own = F.last(column, ignorenulls=True).over(Window.partitionBy("__part").orderBy(*along).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(ends), "__part").withColumn(name, F.coalesce(own, "__beyond")).drop("__part", "__beyond")


def with_halo(sdf: DataFrame, order: list[str], back: int, ahead: int = 0, rows: int = BUCKET_ROWS) -> DataFrame:
    """``sdf`` with ``POS``, ``__bucket`` and ``__own``: each bucket also has the ``back`` rows before and ``ahead`` rows after it."""
    rows = max(rows, back, ahead, 1)
    placed = positions(sdf, order).withColumn("__home", F.floor(F.col(POS) / rows))
    into = F.array_distinct(F.array(F.col("__home"), F.floor((F.col(POS) + back) / rows), F.greatest(F.lit(0), F.floor((F.col(POS) - ahead) / rows))))
    spread = placed.withColumn("__bucket", F.explode(into))
    return spread.withColumn("__own", F.col("__bucket") == F.col("__home")).drop("__home")
