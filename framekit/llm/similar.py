"""All pairs of documents with a shingle similarity of 0.8 or more, by prefix filtering.

A document is the set of its shingles of ``SHINGLE`` words (lower case, split at white space; a shorter text is one
shingle), as 64-bit hashes. In any fixed order of shingles, two sets of a similarity of 4/5 or more share one among the
first n // 5 + 1 of each, n being the set's size. The order is by hash, hot shingles last: passages that many documents share then
form no pairs. The order decides the cost, never the result.

Pairs that share a shingle of their prefixes, and whose sizes and places in the order allow the similarity, are candidates and
compared exactly. Documents with equal sets are linked to the least of them, which stands for all.

Only links that connect are looked for. First each document is compared with one hub for each of its shingles: the
document that has the shingle earliest in its order, and so the fewest shingles of its own. That joins most
of a group of near copies, however large, by as many comparisons as it has members; a second turn takes ``HUBS`` other hubs. Then all candidates are
compared that aren't connected yet: of each shingle, the documents outside its largest component with the others. Candidates are first held
against sketches: ``SKETCH`` bits, each the parity of the number of a set's shingles that fall on it. Two sketches differ in no more bits than the sets
do in shingles, which may be a ninth of both sizes at most; sets of up to some 300 shingles that are near, but not near enough, go here.

Defined results: blank texts have no shingles and no links; rows that share an id are one document and link by any of
their texts; rows without an id link nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, utf8
from .components import components

SHINGLE, HOT, MOST_HOT, HUBS, SKETCH, BUCKET, SEED = 5, 16, 100_000, 4, 256, 24, 42


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.int64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64).view(np.int64))


def prefix(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first shingles that a set shares with any similar one; ``hot`` is sorted and holds them without their last BUCKET bits."""
    if len(hot):
        at = np.minimum(np.searchsorted(hot, tokens >> BUCKET), len(hot) - 1)
        late = hot[at] == tokens >> BUCKET
        tokens = np.concatenate([tokens[~late], tokens[late]])
    return tokens[: len(tokens) // 5 + 1]


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The parities of a set's shingles as SKETCH // 64 integers."""
    odd = np.bincount(tokens & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _map(docs: DataFrame, fields: str, row) -> DataFrame:
    """``row`` of the shingles of each (doc_id, text) of ``docs``: values of ``fields`` beside doc_id."""
    schema = pa.schema([("doc_id", pa.int64()), *[(n, {"int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[k]) for n, k in (f.split() for f in fields.split(", "))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [row(shingles(t)) for t in utf8(b.column(1))]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.names[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, schema.types[1:], strict=True)]], schema.names)

    return docs.mapInArrow(run, f"doc_id long, {fields}")


def postings(docs: DataFrame, hot_docs: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """token, rep, n, place of the prefix shingles that several sets share; rep, sketch; and links a, b of documents to the least one with
    the same set. ``docs``: doc_id, text."""
    # a quarter more than the prefix: what comes forward when hot shingles go back has been counted too
    often = _map(docs, "head array<long>", lambda s: (s[: len(s) // 4 + 2] >> BUCKET,)).select(F.explode("head").alias("token")).groupBy("token").count()
    hot = np.sort(np.array([r["token"] for r in often.where(F.col("count") > hot_docs).orderBy(F.desc("count"), "token").limit(MOST_HOT).collect()], np.int64))
    sets = cut(_map(docs, "digest binary, n int, head array<long>, sketch array<long>", lambda s: (xxhash.xxh3_128_digest(s.tobytes()), len(s), prefix(s, hot), sketch(s))).where("n > 0"), "prefixes")
    first = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    copies = sets.join(first.hint("merge"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    kept = sets.join(first.hint("merge"), "digest").where("doc_id = rep").dropDuplicates(["digest"])
    posted = kept.select("rep", "n", F.posexplode("head").alias("place", "token"))
    shared = kept.select(F.explode("head").alias("token")).groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    return cut(posted.join(shared.hint("merge"), "token", "left_semi"), "shared"), kept.select("rep", "sketch"), cut(copies, "copies")


def _fits(x: str, y: str) -> Column:
    """9 * common >= 4 * (sum of sizes) is a similarity of 4/5; at the first common shingle, what follows bounds what is common."""
    return F.expr(f"9 * least({x}.n - {x}.place, {y}.n - {y}.place) >= 4 * ({x}.n + {y}.n)")


def _may(x: str, y: str) -> Column:
    """As ``_fits``, and by the sketches."""
    differ = " + ".join(f"bit_count({x}.sketch[{i}] ^ {y}.sketch[{i}])" for i in range(SKETCH // 64))
    return _fits(x, y) & F.expr(f"9 * ({differ}) <= {x}.n + {y}.n")


def _distinct(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _with_hubs(posted: DataFrame, order: list[Column], hubs: int, fits=_may) -> DataFrame:
    """Candidates a < b of documents and the first ``hubs`` in ``order`` for each of their shingles, of other components."""
    first = posted.withColumn("__at", F.row_number().over(Window.partitionBy("token").orderBy(*order))).where(F.col("__at") <= hubs).drop("__at")
    return _distinct(posted.alias("x").join(first.hint("merge").alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & fits("x", "y")))


def _across(posted: DataFrame) -> DataFrame:
    """All candidates a < b of different components."""
    sizes = posted.groupBy("token", "comp").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("top"))
    few = posted.join(largest.hint("merge"), "token").where("comp <> top")
    once = "x.comp <> y.comp and (y.comp = x.top or x.rep < y.rep)"
    return _distinct(few.alias("x").join(posted.hint("merge").alias("y"), (F.col("x.token") == F.col("y.token")) & F.expr(once) & _may("x", "y")))


def verified(near: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the candidates a, b that are similar. ``docs``: doc_id, text; of several texts of an id any will do."""
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(ids.hint("merge"), "doc_id", "left_semi")
    of = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"of_{c}"))
    both = near.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for b in slices(batches):
            found = []
            for x, y in zip(utf8(b.column(2)), utf8(b.column(3)), strict=True):
                if y != last:  # rows come in the order of b
                    last, known = y, shingles(y)
                own = shingles(x)
                common = len(own) + len(known) - len(np.union1d(own, known))
                found.append(9 * common >= 4 * (len(own) + len(known)))
            yield b.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_docs: int = HOT) -> DataFrame:
    """Edges a, b that connect all documents with a shingle similarity of 4/5 or more."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    posted, sketches, edges = postings(docs, hot_docs)
    posted = posted.withColumn("comp", F.col("rep"))
    turns = (
        lambda p: _with_hubs(p, [F.col("place"), F.col("rep")], 1, _fits),
        lambda p: _with_hubs(p, [F.xxhash64(F.lit(SEED), "rep")], HUBS),
        _across,
    )
    for turn, candidates in enumerate(turns):
        edges = edges.unionByName(cut(verified(cut(candidates(posted), "candidates"), docs), "similar"))
        if turn < len(turns) - 1:
            roots = components(edges)
            about = sketches.join(roots, sketches["rep"] == roots["id"], "left").select("rep", "sketch", F.coalesce("root", "rep").alias("comp"))
            named = posted.select("token", "rep", "n", "place").join(about, "rep")
            open_ = named.groupBy("token").agg((F.min("comp") < F.max("comp")).alias("open")).where("open").select("token")
            posted = cut(named.join(open_.hint("merge"), "token", "left_semi"), "open")
    return edges
