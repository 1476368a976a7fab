"""SimHash near-duplicate detection with pigeonring filtering.

Fingerprints have 64 bits and link at no more than ``TAU`` = 2 differing bits. The bits are cut into a ring of ``M``
segments. By the pigeonring principle, two fingerprints within TAU have a start on the ring from which every chain
of consecutive segments of length l differs in at most l * TAU / M bits in all. With M = 7 that means: three
consecutive segments agree, and the chain of four differs in one bit at most.

Candidates are pruned in that order. First the fingerprints whose three agreeing segments (27 or 28 bits) occur
nowhere else go, then those of whom no other has the chain of four with one bit free. What is left meets for the full
Hamming check: two fingerprints are within two bits if and only if they have a common neighbour (or themselves)
within one bit, so each goes to its 65 such points, and those that meet at a point are linked to the least of them.
This finds every link without forming the pairs of a group, whatever its size.

Defined results: null and blank texts have fingerprint zero and link like others; a text of fewer than three words
is one shingle; rows that share an id are one document and stay or go together; rows without an id get the component
of their fingerprint but don't link others; columns beyond id and text are ignored by ``near_duplicates`` and kept by
``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, utf8
from .components import components
from .similar import similar

SHINGLE, SEED, TAU, M = 3, 42, 2, 7
#: First bit of each segment of the ring, and the end.
EDGES = [round(i * 64 / M) for i in range(M + 1)]


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8: bit i is set if it is set in over half of the shingles' hashes."""
    w = text.lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([simhash(t, shingle) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segments(start: int, length: int) -> list[int]:
    return [bit for s in range(start, start + length) for bit in range(EDGES[s % M], EDGES[s % M + 1])]


def _mask(bits: list[int]) -> Column:
    return F.lit(_signed(sum(1 << b for b in bits))).cast("long")


def _exact() -> int:
    """Length of the longest chain whose budget is under one bit."""
    return max(n for n in range(1, M) if n * TAU < M)


def candidates(fps: DataFrame) -> DataFrame:
    """The rows of ``fps`` (fp, rep) that the chains of the ring don't rule out.

    Joins of exploded rows are sort-merge joins by hint: Spark takes their size for that of the rows before.
    """
    n = _exact()
    start = lambda i: F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(_mask(_segments(i, n))).alias("key"))
    first = fps.select("fp", "rep", F.explode(F.array(*map(start, range(M)))).alias("x")).select("fp", "rep", "x.*")
    shared = first.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1").select("start", "key")
    alive = first.join(shared.hint("merge"), ["start", "key"], "left_semi").select("fp", "rep", "start")

    def chain(i: int) -> Column:
        free = _segments(i + n, 1)
        whole = _segments(i, n + 1)
        return F.array(*[F.struct(F.lit(b).alias("free"), F.col("fp").bitwiseAND(_mask([x for x in whole if x != b])).alias("key")) for b in free])

    by_start = F.when(F.lit(False), chain(0))
    for i in range(M):
        by_start = by_start.when(F.col("start") == i, chain(i))
    second = alive.select("fp", "rep", "start", F.explode(by_start).alias("x")).select("fp", "rep", "start", "x.*")
    shared = second.groupBy("start", "free", "key").agg(F.count("*").alias("n")).where("n > 1").select("start", "free", "key")
    return second.join(shared.hint("merge"), ["start", "free", "key"], "left_semi").select("fp", "rep").distinct()


def links(found: DataFrame) -> DataFrame:
    """Edges a, b between representatives whose fingerprints are within two bits, enough to connect all of them."""
    points = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    near = found.select("rep", F.explode(points).alias("point"))
    hubs = near.groupBy("point").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b")
    return near.join(hubs.hint("merge"), "point").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row.

    Copies collapse by fingerprint first, with map-side minima; the tables below have a row per fingerprint. The
    last join is on the fingerprint, which a hot group may share: a sort-merge join that Spark splits.
    """
    of_docs = cut(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    fps = of_docs.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = cut(candidates(fps.where("rep is not null")), "candidates")
    roots = components(cut(links(found), "links"))
    named = fps.join(roots, fps["rep"] == roots["id"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return of_docs.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is the first of its group."""
    gone = near_duplicates(docs, doc_id, text, shingle).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")


def deduplicate_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``deduplicate``, with links also between all documents with a five-word similarity of 0.8 or more.

    No radius of fingerprints holds a similarity, so these links are found by ``similar``, exactly.
    """
    near = near_duplicates(docs, doc_id, text).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    roots = components(cut(near.unionByName(similar(docs, doc_id, text)), "links"))
    gone = roots.where("id <> root").select(F.col("id").alias("_gone"))
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
