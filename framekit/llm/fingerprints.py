"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line with at least one character) contributes itself and its pieces of 64 characters as elements.
Each element is hashed to a vector of ``WIDTH`` integers modulo 2**60, each holding three lanes of 20 bits with an
odd value between -15 and 15, and a document's fingerprint is the sum of its elements' vectors. Sums commute, so
the fingerprint does not depend on the order of paragraphs, equal texts have equal fingerprints, and a paragraph is
inserted or deleted by adding or subtracting its vector. Lanes have mean zero, so that inner products of lane
vectors estimate the number of shared elements: ``likeness`` is twice that over the sum of both sizes.

Defined results: null and empty texts have the zero fingerprint and likeness 1 to each other; repeated rows each get
their row; of several rows that share an id, the neighbour of the next higher id is the one with the least text;
rows without id come last; columns beyond id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, partitions

WIDTH, LANES, BITS, PIECE = 32, 3, 20, 64
_ONES = sum(1 << (BITS * i) for i in range(LANES))
_NIBBLES, _OFFSET, _MODULUS_MASK = 15 * _ONES, 15 * _ONES, (1 << (BITS * LANES)) - 1


def _modulo(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MODULUS_MASK))


def vector(text: Column) -> Column:
    """The fingerprint of ``text`` as an array of WIDTH integers."""
    t = F.coalesce(text, F.lit(""))
    paragraphs = F.transform(F.filter(F.split(t, "\n"), lambda p: p != ""), lambda p: F.xxhash64(p, F.lit(-1)))
    pieces = F.transform(F.regexp_extract_all(t, F.lit("[^\n]{1,%d}" % PIECE), F.lit(0)), lambda p: F.xxhash64(p))
    lane = lambda h, j: F.shiftleft(F.xxhash64(h, j).bitwiseAND(F.lit(_NIBBLES)), 1) - F.lit(_OFFSET)
    return let(F.concat(paragraphs, pieces), lambda hashes: F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda j: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: _modulo(a + lane(h, j)))))


def insert(fingerprint: Column, added: Column) -> Column:
    """The fingerprint of a document with the paragraphs of vector ``added`` put in, anywhere."""
    return F.zip_with(fingerprint, added, lambda a, b: _modulo(a + b))


def delete(fingerprint: Column, removed: Column) -> Column:
    """The fingerprint of a document without the paragraphs of vector ``removed``."""
    return F.zip_with(fingerprint, removed, lambda a, b: _modulo(a - b))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def lanes(fingerprint: Column) -> Column:
    """The signed lanes of a fingerprint, as doubles."""
    half, full = 1 << (BITS - 1), (1 << BITS) - 1
    signed = lambda x: (x + half).bitwiseAND(F.lit(full)) - half

    def split(x: Column) -> Column:
        second = F.shiftright(x - signed(x), BITS)
        return F.array(signed(x), signed(second), signed(F.shiftright(second - signed(second), BITS)))

    return F.transform(F.flatten(F.transform(fingerprint, split)), lambda v: v.cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of elements that two fingerprints have in common, 0 to 1; 1 for equal ones."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    estimate = let(F.struct(lanes(a).alias("a"), lanes(b).alias("b")), lambda p: 2 * dot(p["a"], p["b"]) / F.greatest(dot(p["a"], p["a"]) + dot(p["b"], p["b"]), F.lit(1.0)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and fingerprint (array of WIDTH integers) of every row."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("fingerprint", vector(F.col("text")))


def successors(ids: DataFrame) -> DataFrame:
    """doc_id, next_id for distinct ids in descending order, the last one's being the first; null ids come last.

    Ids are dealt by range, so that each range is ordered on its own; only the ranges' ends, one row each, are
    ordered together.
    """
    ranged = cut(ids.repartitionByRange(partitions(ids), F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "ids")
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first())
    ends = ranged.groupBy("part").agg(F.max_by(F.struct("doc_id"), F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("top"))
    across = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("top").over(across), F.last("top").over(across.rowsBetween(0, Window.unboundedFollowing))).alias("below"))
    return ranged.withColumn("own", F.lag(F.struct("doc_id")).over(inside)).join(ends, "part").select("doc_id", F.coalesce("own", "below")["doc_id"].alias("next_id"))


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its last third replaced by the start of the next document, and both fingerprints.

    The edited fingerprint is the document's without the paragraphs that the edit touches plus what replaces them.
    Texts are shuffled once by id; of each, at most a third of its neighbour's length is sent on.
    """
    own = fingerprints(docs, doc_id, text)
    lengths = docs.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.length(F.coalesce(F.col(text), F.lit("")))).alias("n"))
    links = successors(lengths.select("doc_id")).join(lengths.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    links = links.select(F.col("next_id").alias("donor_id"), F.col("doc_id").alias("user_id"), F.floor(F.col("n") / 3).cast("int").alias("need"))
    donors = own.join(links, F.col("doc_id").eqNullSafe(F.col("donor_id"))).groupBy("user_id").agg(F.min(F.struct(F.expr("left(text, need)").alias("start"), F.col("fingerprint"))).alias("next"))
    both = own.join(donors, F.col("doc_id").eqNullSafe(F.col("user_id")))
    both = both.select("doc_id", "text", "fingerprint", F.length("text").cast("long").alias("n_chars"), F.col("next.start").alias("start"), F.col("next.fingerprint").alias("next_fingerprint"))
    both = both.withColumn("stay", F.expr("left(text, cast(n_chars - floor(n_chars / 3) as int))"))
    both = both.withColumn("edited", F.concat("stay", F.expr("left(start, cast(floor(n_chars / 3) as int))")))
    at = F.length("stay") - F.length(F.substring_index("stay", "\n", -1)) + 1
    both = both.withColumn("touched", F.struct(F.substr("text", at).alias("old"), F.substr("edited", at).alias("new")))
    return both.withColumn("edited_fingerprint", insert(delete(F.col("fingerprint"), vector(F.col("touched.old"))), vector(F.col("touched.new"))))
