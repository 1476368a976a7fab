"""Quality rules whose cutoffs come with a guarantee on false rejections.

Every rule scores a document (higher is worse) and has a fixed grid of cutoffs, loosest first. A labelled
holdout decides how far down its grid each rule may go in each stratum: with ``n`` good documents of which
``k`` lie above a cutoff, the exact binomial (Clopper-Pearson) upper bound on the false-rejection rate is at most
``alpha`` if and only if ``P(Binomial(n, alpha) <= k) <= delta``. Cutoffs are tested in their fixed order and the
walk stops at the first that fails, which needs no further correction; ``delta`` is divided among rules and strata
(Bonferroni) and ``alpha`` among rules, so that with probability ``1 - delta`` no stratum loses more than ``alpha``
of its good documents to all rules together. A stratum with too few labels has no cutoffs and loses nothing.

Defined results: a null text counts as empty; a null stratum is a stratum of its own; a null label is no label;
several labels of one document count as their least; repeated documents each get their row; columns beyond id,
text and stratum are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Cutoffs of each rule, loosest first.
GRIDS: dict[str, list[float]] = {
    "symbols": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03],
    "duplicate_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeated_words": [0.2, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03],
    "word_length": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0],
}
ALPHA, DELTA = 0.02, 0.05


def repeated_words(w: Column) -> Column:
    """Number of words in windows of five words found at least twice; windows are compared by a 64-bit hash."""

    def position_count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            near = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, j: near(x, j - 1) | near(x, j + 1)), lambda x: x["i"]))

        def covered(p: Column) -> Column:
            new = F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))))
            return F.aggregate(new, F.lit(0), lambda a, b: a + b)

        repeats = let(ordered, lambda s: let(twice(s), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(repeats)

    def of(x: Column) -> Column:
        windows = F.transform(F.slice(x, 1, F.size(x) - (WINDOW - 1)), lambda v, i: F.xxhash64(v, *[F.get(x, i + k) for k in range(1, WINDOW)]))
        return F.when(F.size(x) < WINDOW, F.lit(0)).otherwise(let(windows, position_count))

    return let(w, of)


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str | None = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every document, from its whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.col(stratum).cast("string") if stratum else F.lit("all")).alias("stratum"),
        let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )
    n_words, n_repeat = F.col("w.n_words"), F.col("w.n_repeat_words")
    return base.select(
        "doc_id", "stratum", n_words.alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), n_repeat.alias("n_repeat_words"), F.col("l.n").alias("n_lines"),
        ((n_words < 10) | (100 * n_repeat > 20 * n_words)).alias("base_failed"),
    )


def scores() -> dict[str, Column]:
    over = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
    return {"symbols": over("n_symbols", "word_chars"), "duplicate_lines": over("n_dup_lines", "n_lines"), "repeated_words": over("n_repeat_words", "n_words"), "word_length": over("word_chars", "n_words")}


def log_factorial(x: Column) -> Column:
    """ln x!, from a list below 10 and by Stirling's series above (absolute error under 1e-10)."""
    x = x.cast("double")
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)])
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(x < 10, F.get(small, x.cast("int"))).otherwise(series)


def binomial_tail_at_most(k: Column, n: Column, p: float, bound: Column) -> Column:
    """Whether P(Binomial(n, p) <= k) <= bound, for bound < 1/2.

    At or above the mean the probability exceeds 1/2 - 1/n; below it the terms fall off at least geometrically
    from k down, so a few standard deviations of them hold the sum to the last bits of a double.
    """
    reach = (F.sqrt(n * p) * 12 + 60).cast("int")
    term = lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = F.aggregate(F.transform(F.sequence(F.greatest(F.lit(0), k - reach).cast("int"), k.cast("int")), term), F.lit(0.0), lambda a, b: a + b)
    return F.when(k >= n * p, F.lit(False)).otherwise(total <= bound)


def calibrate(feats: DataFrame, labels: DataFrame, grids: dict[str, list[float]] | None = None, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cutoffs (map of rule to the tightest cutoff that the holdout allows; rules with none are absent).

    ``labels``: doc_id and quality (1: good). One aggregation over the labelled documents; what follows has a row
    for each stratum and rule.
    """
    grids = grids or GRIDS
    s = scores()
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    exceeded = lambda score, grid: F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: score > c))
    above = [F.struct(F.lit(rule).alias("rule"), exceeded(s[rule], grid).alias("m")) for rule, grid in grids.items()]
    counted = (
        feats.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
        .select("stratum", F.explode(F.array(*above)).alias("x"))
        .groupBy("stratum", "x.rule", "x.m").agg(F.count("*").alias("c"))
        .groupBy("stratum", "rule").agg(F.collect_list(F.struct("m", "c")).alias("hist"), F.sum("c").alias("n"))
        .withColumn("strata", F.count("*").over(Window.partitionBy("rule")))
    )
    grid_of = F.create_map(*[x for rule, grid in grids.items() for x in (F.lit(rule), F.array(*map(F.lit, grid)))])
    grid = F.element_at(grid_of, F.col("rule"))
    bound = F.lit(delta / len(grids)) / F.col("strata")
    rejected = lambda j: F.aggregate(F.filter("hist", lambda x: x["m"] >= F.size(grid) - j), F.lit(0).cast("long"), lambda a, x: a + x["c"])
    allowed = F.transform(grid, lambda c, j: F.exists(F.array(rejected(j)), lambda k: binomial_tail_at_most(k, F.col("n"), alpha / len(grids), bound)))
    walked = counted.select("stratum", "rule", grid.alias("grid"), allowed.alias("ok")).select(
        "stratum", "rule", "grid", F.when(F.array_contains("ok", F.lit(False)), F.array_position("ok", F.lit(False)) - 1).otherwise(F.size("ok")).cast("int").alias("depth")
    )
    return walked.where("depth > 0").groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.get("grid", F.col("depth") - 1)))).alias("cutoffs"))


def apply_rules(feats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The features and ``rejected_by`` (rules above their cutoff) and ``kept``."""
    c = cutoffs.select(F.col("stratum").alias("_stratum"), "cutoffs")
    joined = feats.join(c, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    hits = F.array_compact(F.array(*[F.when(s > F.try_element_at("cutoffs", F.lit(rule)), F.lit(rule)) for rule, s in scores().items()]))
    return joined.select(*feats.columns, hits.alias("rejected_by")).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Score every document, calibrate the rules on the labelled ones, decide on all.

    The features, some hundred bytes a document, are written once; calibration and decision read them.
    """
    feats = cut(features(docs, stratum=stratum), "features")
    return apply_rules(feats, calibrate(feats, labels, alpha=alpha, delta=delta))
