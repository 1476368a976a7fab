"""Whole-column reductions: missing values skipped, sums of nothing 0, products of nothing 1, the rest of nothing NULL."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ranged

if TYPE_CHECKING:
    from ..frame import Frame, Series


def _spread(c: Column, ddof: int, root: bool) -> Column:
    c = c.cast("double")
    if ddof == 1:
        return F.stddev_samp(c) if root else F.var_samp(c)
    n = F.count(c)
    v = F.when(n > ddof, F.var_pop(c) * n / F.when(n != ddof, n - ddof))
    return F.sqrt(v) if root else v


def skewness(c: Column) -> Column:
    """Adjusted Fisher-Pearson; up to two values the plain ratio; NULL without spread."""
    c = c.cast("double")
    n = F.count(c)
    g = F.when(F.var_pop(c) > 0, F.skewness(c))
    return F.when(n > 2, g * F.sqrt(n * (n - 1)) / F.when(n != 2, n - 2)).otherwise(g)


def kurtosis(c: Column) -> Column:
    """Adjusted excess; from four values on; 0 without spread."""
    c = c.cast("double")
    n = F.count(c)
    g = F.when(F.var_pop(c) > 0, F.kurtosis(c)).otherwise(F.lit(-3.0) + 0)
    adjusted = (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * g + 6)
    return F.when(n > 3, F.when(F.var_pop(c) > 0, adjusted).otherwise(0.0))


def reduction(name: str, c: Column, skipna: bool = True, ddof: int = 1, dropna: bool = True) -> Column:
    """The aggregate expression of a reduction. Without ``skipna`` a missing value makes the result NULL."""
    results = {
        "sum": lambda: F.coalesce(F.sum(c), F.lit(0)),
        "prod": lambda: F.coalesce(F.product(c), F.lit(1.0)),
        "mean": lambda: F.avg(c),
        "median": lambda: F.median(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "std": lambda: _spread(c, ddof, True),
        "var": lambda: _spread(c, ddof, False),
        "skew": lambda: skewness(c),
        "kurt": lambda: kurtosis(c),
        "count": lambda: F.count(c),
        "nunique": lambda: F.count_distinct(c) + (F.lit(0) if dropna else F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))),
    }
    out = results[name]()
    if not skipna and name not in ("count", "nunique"):
        out = F.when(F.count(c) == F.count(F.lit(1)), out)
    return out


def quantiles(sdf: DataFrame, values: dict[str, Column], points: list[float], skipna: bool = True) -> DataFrame:
    """One row: for each name the array of exact quantiles of its values, interpolated; NULL where nothing is known.

    Values are counted and dealt by ranges; a range that holds a wanted rank, and no other, gets a running sum of its counts.
    Missing values are skipped; without ``skipna`` one of them makes the result NULL.
    """
    if any(not 0 <= q <= 1 for q in points):
        raise ValueError("quantiles lie between 0 and 1")
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()])
    counted = sdf.select(F.explode(pairs).alias("x")).select("x.*").groupBy("name", "value").agg(F.count("*").alias("n"))
    dealt = ranged(counted, ["name", "value"])
    known = F.col("value").isNotNull()
    sums = dealt.groupBy("name", "__part").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(a) for c, a in ((known, "here"), (~known, "missing"))])
    of_name = Window.partitionBy("name")  # one row for each range
    before = F.coalesce(F.sum("here").over(of_name.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("name", "__part", "here", before.alias("before"), F.sum("here").over(of_name).alias("all"), F.sum("missing").over(of_name).alias("missing"))
    places = sums.where("all > 0" if skipna else "all > 0 and missing = 0").select("*", F.posexplode(F.array(*[F.lit(float(q)) for q in points])).alias("i", "q")).withColumn("place", (F.col("all") - 1) * F.col("q"))
    # a rank between two values weighs them by how near they are
    ranks = F.array(F.struct(F.floor("place").alias("rank"), (F.floor("place") + 1 - F.col("place")).alias("weight")), F.struct(F.ceil("place").alias("rank"), (F.col("place") - F.floor("place")).alias("weight")))
    wanted = places.select("name", "__part", "i", "here", "before", F.explode(ranks).alias("r")).where("r.rank >= before and r.rank < before + here").select("name", "__part", "i", (F.col("r.rank") - F.col("before")).alias("rank"), "r.weight")
    held = dealt.where(known).join(F.broadcast(wanted.select("name", "__part").distinct()), ["name", "__part"], "left_semi")
    upto = F.sum("n").over(Window.partitionBy("name", "__part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    hits = held.withColumn("upto", upto).join(F.broadcast(wanted), ["name", "__part"]).where("rank < upto and rank >= upto - n")
    between = F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(F.sum(F.col("value") * F.col("weight")))
    found = hits.where("weight > 0").groupBy("name", "i").agg(between.alias("q"))
    pick = lambda n, i: F.max(F.when((F.col("name") == n) & (F.col("i") == i), F.col("q")))
    return found.agg(*[F.when(F.count(F.when(F.col("name") == n, 1)) > 0, F.array(*[pick(n, i) for i in range(len(points))])).alias(n) for n in values])


def frame_reduce(frame: Frame, name: str, **options) -> DataFrame:
    """A row for each data column: column, value. All columns in one pass."""
    if name == "median":
        row = quantiles(frame.sdf, {c: F.col(f"`{c}`") for c in frame.columns}, [0.5], options.get("skipna", True))
        return row.select(*[F.col(f"`{c}`")[0].alias(c) for c in frame.columns]).unpivot([], [F.col(f"`{c}`") for c in frame.columns], "column", "value")
    row = frame.sdf.agg(*[reduction(name, F.col(f"`{c}`"), **options).cast("double" if name != "count" else "long").alias(c) for c in frame.columns])
    return row.unpivot([], [F.col(f"`{c}`") for c in frame.columns], "column", "value")


def pairwise(a: Series, b: Series, kind: str, least: int, alias: str) -> DataFrame:
    """Covariance or correlation of rows where both are known; series of different frames meet by position."""
    x, y = a.expr.cast("double"), b.expr.cast("double")
    sdf = a.frame.sdf
    if a.frame.lineage != b.frame.lineage:
        from .ordering import POS

        sdf = a.frame.positioned().select(POS, x.alias("__a")).join(b.frame.positioned().select(POS, y.alias("__b")), POS)
        x, y = F.col("__a"), F.col("__b")
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    scale = F.stddev_pop(x) * F.stddev_pop(y)  # corr() itself raises without spread
    found = F.covar_samp(x, y) if kind == "cov" else F.covar_pop(x, y) / F.when(scale > 0, scale)
    return sdf.agg(F.when(n >= least, F.when(~F.isnan(found), found)).alias(alias))


def extreme_label(series: Series, largest: bool) -> DataFrame:
    """The label of the first extreme value, in a column ``label``."""
    sdf, labels = series.frame.labelled()
    order = series.frame.order or labels
    label = F.col(labels[0]) if len(labels) == 1 else F.struct(*labels)
    best = F.max(series.expr) if largest else F.min(series.expr)
    # of equal values the first in order: the least order key among the rows with the extreme
    top = sdf.agg(best.alias("__best"))
    tied = sdf.select(series.expr.alias("__v"), label.alias("__label"), F.struct(*order).alias("__order")).join(F.broadcast(top), F.col("__v") == F.col("__best"))
    return tied.agg(F.min_by("__label", "__order").alias("label"))


def value_counts(series: Series, sort: bool, ascending: bool, dropna: bool) -> DataFrame:
    """value and count; by count and then value, unless ``sort`` is off."""
    rows = series.frame.sdf.select(series.expr.alias("value"))
    if dropna:
        rows = rows.where(F.col("value").isNotNull())
    counted = rows.groupBy("value").agg(F.count("*").alias("count"))
    return counted.orderBy(F.col("count").asc() if ascending else F.col("count").desc(), "value") if sort else counted


def describe(frame: Frame, percentiles: list[float] | None = None) -> DataFrame:
    """stat, and a column for each data column: numbers get count, mean, std, min, percentiles, max; text gets count, unique, top, freq."""
    points = sorted({0.5, *(percentiles if percentiles is not None else [0.25, 0.75])})
    kinds = dict(frame.sdf.dtypes)
    text = [c for c in frame.columns if kinds[c] == "string"]
    if text and len(text) == len(frame.columns):
        out = None
        for c in frame.columns:
            col = F.col(f"`{c}`")
            top = frame.sdf.where(col.isNotNull()).groupBy(col.alias("v")).agg(F.count("*").alias("n")).agg(F.max_by("v", F.struct("n", F.col("v"))).alias("top"), F.max("n").alias("freq"), F.count("*").alias("unique"), F.sum("n").alias("count"))
            one = top.select(F.stack(F.lit(4), F.lit("count"), F.coalesce("count", F.lit(0)).cast("string"), F.lit("unique"), F.col("unique").cast("string"), F.lit("top"), F.col("top"), F.lit("freq"), F.col("freq").cast("string")).alias("stat", c))
            out = one if out is None else out.join(one, "stat")
        return out
    names = ["count", "mean", "std", "min", *[f"{100 * p:g}%" for p in points], "max"]
    numbers = [c for c in frame.columns if c not in text]
    cols = {c: F.col(f"`{c}`").cast("double") for c in numbers}
    stats = frame.sdf.agg(*[F.array(F.count(c).cast("double"), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)).alias(f"__s{i}") for i, c in enumerate(cols.values())])
    inner = quantiles(frame.sdf, cols, points).toDF(*[f"__q{i}" for i in range(len(numbers))])
    # two rows of one line each become one
    both = stats.unionByName(inner, allowMissingColumns=True)
    row = both.agg(*[F.any_value(c, F.lit(True)).alias(c) for c in both.columns])
    none = F.array(*[F.lit(None).cast("double")] * len(points))
    row = row.select(*[F.concat(F.slice(f"__s{i}", 1, 4), F.coalesce(f"__q{i}", none), F.slice(f"__s{i}", 5, 1)).alias(c) for i, c in enumerate(numbers)])
    return row.withColumn("stat", F.array(*map(F.lit, names))).select(F.explode(F.arrays_zip("stat", *[F.col(f"`{c}`") for c in numbers])).alias("x")).select("x.*")
