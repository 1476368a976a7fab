"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 100% of all words by weight; a target
stops at ``REPEATS`` times its source's size and the excess is shared again by weight. A source's documents are dealt
by a seeded hash into blocks of about ``BLOCK`` words. A target is so many whole passes over the source and a rest,
for which blocks are taken in a seeded permutation; of the block in which the rest ends, documents are taken in seeded
order, each that still fits what the ones before it have left, in ``FILLS`` turns.

The taken blocks (a block of several passes counts for each) are split among output shards by a tree: a node's quotas,
one per source, are divided between its halves by a multivariate hypergeometric draw, down to the shards. Shards then
draw disjoint blocks off the permutation by their quotas, and order their documents by a seeded hash. What is taken of a
document is what the shards have drawn. All draws are seeded by the tree's place, so reruns agree.

Running sums over a source's permuted blocks are made in ranges of the permutation, of some ``RANGE_BLOCKS`` blocks, from the sums of the
ranges before. Shards hold about ``SHARD_BLOCKS`` blocks and are ``SHARDS`` at least; blocks grow where there would be over ``MOST_BLOCKS``.

Defined results: null texts have size 0; documents of size 0 are taken with their block; a null source is a source of
its own, the last; repeated rows share a block and are taken each; a corpus without words takes nothing; an empty
table gives an empty table. The driver sees a row for each source, and makes one for each source and shard (``MOST_QUOTAS`` at most).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CLASS, cut, partitions

WEIGHTS, REPEATS, BLOCK, SEED, SHARDS, FILLS = (5, 2, 1), 3, 100_000, 17, 16, 5
RANGE_BLOCKS, SHARD_BLOCKS, MOST_BLOCKS, MOST_QUOTAS = 4096, 1024, 500_000_000, 4_000_000


def word_count(text: Column) -> Column:
    """Number of words: starts of runs of non-space characters."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_CLASS + "+"))).cast("long")


def targets(sizes: list[int], weights: tuple = WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """What each source, in order, gives of the sum of sizes."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, caps = float(sum(sizes)), [float(repeats * s) for s in sizes]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        share = {i: left * w[i] / sum(w[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > caps[i]}
        for i in over or open_:
            out[i] = caps[i] if over else share[i]
        open_ = open_ - over if over else set()
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources: how many of each source's items every shard draws."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def descend(q: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = q
            return
        middle = (low + high) // 2
        n = int(q.sum())
        half = round(n * (middle - low) / (high - low))
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(q, half, method="marginals") if n else q
        descend(left, low, middle)
        descend(q - left, middle, high)

    descend(np.asarray(quotas, np.int64), 0, shards)
    return out


def _order(*keys: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *keys)


def _running(blocks: DataFrame, value: str, name: str) -> DataFrame:
    """``blocks`` (s, range, key, block, ...) with the sum of ``value`` over the blocks of its source that come before in the permutation."""
    through = lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    sums = blocks.groupBy("s", "range").agg(F.sum(value).alias(value))
    sums = sums.select("s", "range", through(Window.partitionBy("s").orderBy("range")).alias("__base"))
    inside = Window.partitionBy("s", "range").orderBy("key", "block")
    return blocks.withColumn(name, through(inside)).join(sums, ["s", "range"]).withColumn(name, F.col(name) + F.col("__base")).drop("__base")


def _with_shards(blocks: DataFrame, tree: np.ndarray) -> DataFrame:
    """``blocks`` with ``shard_of``: the shard of each of its items, which are numbered from ``first`` on in their source."""
    spark, ends = blocks.sparkSession, np.cumsum(tree, axis=0)
    shards = spark.createDataFrame([(s, shard, int(ends[shard, s])) for shard in range(tree.shape[0]) for s in range(tree.shape[1])], "s int, shard int, end long")
    ranges = blocks.groupBy("s", "range").agg(F.min("first").alias("begin"), F.sum("items").alias("items")).where("items > 0")
    # each shard's end, in the order of items among the ranges' beginnings, falls into the range that began last
    in_order = ranges.select("s", "range", F.col("begin").alias("at"), F.lit(0).alias("is_end")).unionByName(shards.select("s", F.lit(None).cast("long").alias("range"), F.col("end").alias("at"), F.lit(1).alias("is_end")))
    order = Window.partitionBy("s").orderBy("at", F.desc("is_end"), "range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = in_order.withColumn("before", F.sum("is_end").over(order)).withColumn("of", F.last("range", ignorenulls=True).over(order))
    inside = placed.where("of is not null").groupBy("s", F.col("of").alias("range")).agg(F.min("before").alias("low"), F.collect_list(F.when(F.col("is_end") == 1, F.col("at"))).alias("ends"))
    joined = blocks.join(inside, ["s", "range"], "left")
    shard_of = lambda item: (F.col("low") + F.size(F.filter("ends", lambda e: e <= item))).cast("int")
    return joined.withColumn("shard_of", F.when(F.col("items") > 0, F.transform(F.sequence(F.lit(0), F.col("items") - 1), lambda e: shard_of(F.col("first") + e))).otherwise(F.array().cast("array<int>"))).drop("low", "ends")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shards: int | None = None, block_words: int = BLOCK, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (times taken), placed: an array of (shard, place) of the epochs.

    ``place`` orders a shard. Texts are read once, for their sizes; everything else moves ids and numbers.
    """
    return _mix(docs, doc_id, text, source, shards, block_words, range_blocks)[0]


def _mix(docs: DataFrame, doc_id: str, text: str, source: str, shards: int | None = None, block_words: int = BLOCK, range_blocks: int = RANGE_BLOCKS) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    sized = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    per_source.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [r["n"] for r in per_source]
    goals = targets(sizes)
    block_words = max(block_words, math.ceil(sum(sizes) / MOST_BLOCKS))
    n_blocks = [max(1, math.ceil(n / block_words)) for n in sizes]
    plan = spark.createDataFrame(
        [(i, r["source"], n, t, *_passes(n, t), b) for i, (r, n, t, b) in enumerate(zip(per_source, sizes, goals, n_blocks, strict=True))],
        "s int, source string, source_size long, target double, passes int, rest double, blocks long",
    )
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    dealt = sized.join(F.broadcast(plan) if len(sizes) <= 100_000 else plan, same(sized, plan)).drop(sized["source"])
    dealt = dealt.withColumn("block", F.pmod(_order(F.lit("block"), F.col("doc_id")), F.col("blocks")))
    bits = math.ceil(math.log2(max([1, *n_blocks]) / range_blocks)) if max([1, *n_blocks]) > range_blocks else 0
    key = _order(F.lit("permute"), F.col("s"), F.col("block"))
    blocks = dealt.groupBy("s", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    blocks = cut(blocks.withColumn("key", key).withColumn("range", F.shiftright("key", 64 - bits) if bits else F.lit(0).cast("long")), "blocks")
    blocks = _running(blocks, "words", "before")
    blocks = blocks.withColumn("whole", F.col("before") + F.col("words") <= F.col("rest")).withColumn("part", ~F.col("whole") & (F.col("before") < F.col("rest")))
    blocks = cut(blocks.withColumn("items", (F.col("passes") + F.when(F.col("whole") | F.col("part"), 1).otherwise(0)).cast("long")), "taken")
    blocks = cut(_running(blocks, "items", "first"), "permuted")

    counted = {r["s"]: r["n"] for r in blocks.groupBy("s").agg(F.sum("items").alias("n")).collect()}
    quotas = np.array([counted.get(i, 0) for i in range(len(sizes))], np.int64)
    if shards is None:
        shards = max(SHARDS, min(math.ceil(int(quotas.sum()) / SHARD_BLOCKS), MOST_QUOTAS // max(1, len(sizes))))
    blocks = _with_shards(blocks, split_tree(quotas, shards) if sizes else np.zeros((shards, 0), np.int64))

    joined = dealt.join(blocks.select("s", "block", "before", "whole", "part", "shard_of"), ["s", "block"])
    inside = Window.partitionBy("s", "block")
    running = inside.orderBy(_order(F.lit("document"), F.col("doc_id")), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    partial = joined.where("part").withColumn("gap", F.col("rest") - F.col("before")).withColumn("last", F.lit(False))
    for _ in range(FILLS):  # of what still fits, as much in a row as fits
        partial = partial.withColumn("fits", ~F.col("last") & (F.col("size") <= F.col("gap")))
        partial = partial.withColumn("last", F.col("last") | (F.col("fits") & (F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(running) <= F.col("gap"))))
        partial = partial.withColumn("gap", F.col("rest") - F.col("before") - F.sum(F.when(F.col("last"), F.col("size")).otherwise(0)).over(inside))
    partial = partial.drop("gap", "fits")
    taken = joined.where("not part").withColumn("last", F.col("whole")).unionByName(partial)
    taken = taken.withColumn("epochs", F.when(F.col("target") > 0, F.col("passes") + F.col("last").cast("int")).otherwise(0))
    place = lambda shard, e: F.struct(shard.alias("shard"), _order(F.lit("place"), F.col("doc_id"), e).alias("place"))
    return taken.select("doc_id", "source", "size", "source_size", "target", "epochs", F.transform(F.slice("shard_of", F.lit(1), F.col("epochs")), place).alias("placed")), shards


def _passes(size: int, target: float) -> tuple[int, float]:
    """Whole passes over a source, and the words of the rest."""
    if not size:
        return 0, 0.0
    passes = min(int(target // size), REPEATS)
    return passes, max(0.0, target - passes * size)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it, in the order of the mix.

    Each copy goes to the shard that the tree has drawn for it and lies there by its place. Where there are more
    partitions than shards, a shard is cut into equal ranges of places.
    """
    drawn, shards = _mix(docs, doc_id, text, source, **options)
    taken = drawn.where("epochs > 0").groupBy(F.col("doc_id").alias("__id")).agg(F.max_by("placed", "epochs").alias("__placed"))
    joined = docs.join(taken, F.col(doc_id).eqNullSafe(F.col("__id")))
    copies = joined.select(*[docs[c] for c in docs.columns], F.explode("__placed").alias("__at"))
    ranges = math.ceil(partitions(docs) / shards)
    part = F.shiftright((F.shiftright(F.col("__at.place"), 32) + (1 << 31)) * ranges, 32)
    return copies.repartition(partitions(docs), "__at.shard", part).sortWithinPartitions("__at.shard", "__at.place").drop("__at")
