"""Removal of long byte strings that occur more than once, by suffix arrays.

Each byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is removed. Texts are UTF-8 bytes,
matches don't cross them, and equal texts are kept once with their number of copies.

Strings are first sorted into cells. The least hash among the grams of ``GRAM`` bytes in a string depends on the
string alone, so equal strings have equal least hashes; runs of starts with the same least hash form a cell, of some
hundred starts. Only cells of the same hash can share a string:

- a cell whose hash occurs in no other has no repeats, unless its least gram occurs in it twice;
- cells equal as a whole are repeats as a whole, and one of them stands for all;
- the different cells of a hash meet in a shard, with their bytes. A shard of ``SHARD_BYTES`` on average builds the suffix array of its cells
  by Larsson-Sadakane refinement and their common prefixes by Kasai's method; neighbours with a common prefix of LENGTH
  are repeats.

A hash's cells are dealt over so many shards that each has some ``SPLIT`` of them, about a shard's bytes. Where that is more than one, shards write
the digests of their different strings as sorted runs, the runs are dealt by ranges of digests, and each string is looked up in the other
shards' runs by binary search. Texts and strings are known by SHA-256 and BLAKE2b, cells within a hash by 128 bits of the latter: texts from the web can be
made to collide in weaker ones.

Defined results: null texts are empty; repeated rows are copies; texts shorter than LENGTH keep all bytes; kept bytes
may end inside a character and so are binary; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, cut, partitions, slices
from .suffix import common_prefixes, eight_bytes, suffix_array

LENGTH, GRAM, SHARD_BYTES, SPLIT, MERGE_ROWS = 400, 128, 1 << 20, 1024, 200_000
CHUNK, SEGMENT, PLACE_BITS = 1 << 18, 1 << 19, 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two, 8 at least) from each position on; beyond the end, of fewer."""
    h = eight_bytes(data) * _A
    h ^= h >> np.uint64(32)
    size = 8
    while size < gram:
        joined = h * _B
        joined[: max(0, len(h) - size)] += h[size:]
        joined ^= joined >> np.uint64(29)
        joined *= _A
        joined ^= joined >> np.uint64(32)
        h, size = joined, 2 * size
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """min(h[i : i + width]) for each i for which that is whole."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def cells(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """For each text with strings: its number, and its cells' first starts, numbers of starts, hashes, content hashes, and
    whether the least gram occurs in a cell more than once (else the cell can't repeat a string of its own).

    Hashes keep their upper bits; the lower ``PLACE_BITS`` hold the gram's place, so that the leftmost of equals is least.
    Texts longer than a segment are cut into segments that overlap by a string, and a cell ends with its segment.
    """
    width, low = length - gram + 1, np.uint64((1 << PLACE_BITS) - 1)
    for group in _chunks(texts, length):
        joined = b"".join(memoryview(texts[i])[a:z] for i, a, z in group)
        h = gram_hashes(np.frombuffer(joined, np.uint8), gram)
        least = window_minima(h & ~low | np.arange(len(h), dtype=np.uint64), width)
        at = 0
        for i, a, z in group:
            m = least[at : at + z - a - length + 1]
            key = m >> np.uint64(PLACE_BITS)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.concatenate([first, [len(m)]]))
            view = memoryview(joined)[at:]
            content = [blake2b(view[s : s + k + length - 1], digest_size=16).digest() for s, k in zip(first.tolist(), n.tolist(), strict=True)]
            yield i, first + a, n, key[first], content, m[first] != m[first + n - 1]
            at += z - a


def _chunks(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, from, to) of about CHUNK bytes."""
    now, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t) - length + 1, SEGMENT):
            z = min(len(t), a + SEGMENT + length - 1)
            now.append((i, a, z))
            size += z - a
            if size >= CHUNK:
                yield now
                now, size = [], 0
    if now:
        yield now


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest, bytes, copies."""
    t = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).select(text_digest(F.col("t")).alias("digest"), "t")
    return t.groupBy("digest").agg(F.first("t").cast("binary").alias("bytes"), F.count("*").alias("copies"))


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def _all_cells(texts: DataFrame, length: int, gram: int) -> DataFrame:
    names = ["digest", "copies", "at", "n", "hash", "content", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            digests, data, copies = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            found = list(cells(data, length, gram))
            if not found:
                continue
            sizes = [len(f[1]) for f in found]
            owner = np.repeat(np.arange(len(found)), sizes)
            own = pa.array([digests[f[0]] for f in found], pa.binary()).take(pa.array(owner))
            weight = np.array([copies[f[0]] for f in found], np.int64)[owner]
            first, n, h = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
            again = np.concatenate([f[5] for f in found])
            yield pa.RecordBatch.from_arrays([own, pa.array(weight), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), pa.array([c for f in found for c in f[4]], pa.binary()), pa.array(again)], names)

    return texts.select("digest", "bytes", "copies").mapInArrow(run, "digest binary, copies long, at int, n int, hash long, content binary, own boolean")


def _classified(all_cells: DataFrame) -> DataFrame:
    """The cells that may hold repeats: with ``weight``, how often the whole cell occurs, ``kinds``, how many different
    cells have its hash, ``look``, whether single strings have to be compared, and ``first``, whether it stands for its equals.

    Cells are made and dealt by hash once, into a bucketed table; sums and joins below keep its partitioning.
    """
    dealt = bucketed(all_cells.repartition(partitions(all_cells), "hash"), "hash")
    kinds = dealt.groupBy("hash", "n", "content").agg(F.sum("copies").alias("weight"), F.min(F.struct("digest", "at")).alias("rep"), F.max("own").alias("own"))
    groups = kinds.groupBy("hash").agg(F.count("*").alias("kinds"), (F.min("weight") == 1).alias("open"), F.sum("weight").alias("total"), F.max("own").alias("any")).where("total > 1 or any").drop("total", "any")
    marked = kinds.join(groups, "hash").where("weight > 1 or kinds > 1 or own").withColumn("look", F.col("open") & ((F.col("kinds") > 1) | F.col("own")))
    names = ["digest", "copies", "at", "n", "hash", "weight", "kinds", "look"]
    return dealt.drop("own").join(marked, ["hash", "n", "content"]).select(*names, (F.struct("digest", "at") == F.col("rep")).alias("first"))


def shard_repeats(spans: list[bytes], counts: np.ndarray, weights: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Repeats among the first ``counts`` starts of each span, one of them occurring ``weights`` times.

    Returns for each such start, in order: span, offset, whether the string occurs more than once, and the number of its class.
    """
    data = np.frombuffer(b"\xff".join(spans) + b"\xff", np.uint8)
    sizes = np.array([len(s) + 1 for s in spans])
    begin = np.cumsum(sizes) - sizes
    span = np.repeat(np.arange(len(spans)), counts)
    offset = np.arange(len(span)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = begin[span] + offset
    sa = suffix_array(eight_bytes(data), 8, len(data))  # the whole order: common prefixes are carried from suffix to suffix
    classes = np.empty(len(data), np.int64)
    classes[sa] = np.cumsum(common_prefixes(data, sa, length) < length)
    own = classes[place]
    total = np.bincount(own, weights=weights[span], minlength=1)
    return span, offset, total[own] > 1.5, own


def _shard_task(length: int, pieces: int):
    """A shard's repeats, as one row of piece -1, and its sorted run of strings, as a row for each range of digests (piece)."""
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())]
    schema = "shard long, piece int, texts array<binary>, at array<int>, n array<int>, strings array<binary>"

    def run(t: pa.Table) -> pa.Table:
        spans = t["span"].to_pylist()
        digest, at, counts, weights = t["digest"], t["at"].to_numpy(), t["n"].to_numpy(), t["weight"].to_numpy()
        split = np.asarray(t["split"])
        span, offset, repeated, own = shard_repeats(spans, counts, weights, length)
        marked = repeated & (weights[span] == 1)
        head = marked & ~(np.concatenate([[False], marked[:-1]]) & (offset > 0))
        tail = marked & ~(np.concatenate([marked[1:], [False]]) & np.concatenate([offset[1:] > 0, [False]]))
        a, z = np.flatnonzero(head), np.flatnonzero(tail)
        texts, shard = np.array(digest.to_pylist(), object), t["shard"][0].as_py()
        out = [(shard, -1, texts[span[a]].tolist(), (at[span[a]] + offset[a]).tolist(), (z - a + 1).tolist(), [])]
        if split.any():
            of_split = np.flatnonzero(split[span])
            _, once = np.unique(own[of_split], return_index=True)
            pick = of_split[once]
            strings = sorted((blake2b(memoryview(spans[s])[o : o + length], digest_size=32).digest(), i) for i, s, o in zip(pick.tolist(), span[pick].tolist(), offset[pick].tolist(), strict=True))
            piece = np.array([int.from_bytes(d[:4]) * pieces >> 32 for d, _ in strings])
            for p in np.unique(piece).tolist():
                low, high = np.searchsorted(piece, p, "left"), np.searchsorted(piece, p, "right")
                i = np.array([i for _, i in strings[low:high]])
                out.append((shard, p, texts[span[i]].tolist(), (at[span[i]] + offset[i]).tolist(), np.where(repeated[i], 0, 1).tolist(), [d for d, _ in strings[low:high]]))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return run, schema


def merge_runs(strings: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Whether each string (a digest of 32 bytes) is in the run of another shard. A shard's run holds a string once."""
    found = np.zeros(len(strings), bool)
    order = np.lexsort((strings, shard))
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    merged = np.sort(strings)
    for run in np.split(order, cuts):
        found[run] = np.searchsorted(merged, strings[run], "right") - np.searchsorted(merged, strings[run], "left") > 1
    return found


def _merge_task(t: pa.Table) -> pa.Table:
    """Of the runs of one range: digest of the text, at and n of the strings that other shards have too."""
    flat = {c: pc.list_flatten(t[c]).combine_chunks() for c in ("texts", "at", "n", "strings")}
    shard = np.repeat(t["shard"].to_numpy(), pc.list_value_length(t["strings"]).to_numpy())
    found = merge_runs(np.array(flat["strings"].to_pylist(), "S32"), shard) & (flat["n"].to_numpy() > 0)
    return pa.table({"digest": flat["texts"], "at": flat["at"], "n": flat["n"]}).filter(pa.array(found))


def repeated_starts(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, split: int = SPLIT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """digest, at, n: runs of n starts, from byte ``at`` on, of strings that occur elsewhere. ``texts``: digest, bytes, copies."""
    whole = texts.where((F.col("copies") > 1) & (F.length("bytes") >= length)).select("digest", F.lit(0).alias("at"), (F.length("bytes") - (length - 1)).alias("n"))
    marked = cut(_classified(_all_cells(texts, length, gram)), "cells")
    by_cell = marked.where("weight > 1 and copies = 1").select("digest", "at", "n")
    differing = marked.where("first and look")
    ways = F.ceil(F.col("kinds") / split)  # shards of a hash
    size, starts = differing.agg(F.sum(F.col("n") + (length - 1)), F.sum(F.when(ways > 1, F.col("n")))).first()
    shards, pieces = max(1, math.ceil((size or 0) / shard_bytes)), max(1, math.ceil((starts or 0) / MERGE_ROWS))
    salt = F.pmod(F.xxhash64("digest", "at"), ways)
    listed = differing.withColumn("shard", F.pmod(F.xxhash64("hash", salt), F.lit(shards))).groupBy("digest").agg(F.collect_list(F.struct("at", "n", "weight", (ways > 1).alias("split"), "shard")).alias("cells"))
    span = F.transform("cells", lambda c: F.struct(c["at"].alias("at"), c["n"].alias("n"), c["weight"].alias("weight"), c["split"].alias("split"), c["shard"].alias("shard"), F.substring("bytes", c["at"] + 1, c["n"] + (length - 1)).alias("span")))
    spans = texts.join(listed, "digest").select("digest", F.explode(span).alias("x")).select("digest", "x.*")
    run, schema = _shard_task(length, pieces)
    found = cut(spans.groupBy("shard").applyInArrow(run, schema), "shards")
    inside = found.where("piece < 0").select(F.explode(F.arrays_zip("texts", "at", "n")).alias("x")).select(F.col("x.texts").alias("digest"), "x.at", "x.n")
    across = found.where("piece >= 0").groupBy("piece").applyInArrow(_merge_task, "digest binary, at int, n int")
    parts = [whole, by_cell, inside, across]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, **limits: int) -> DataFrame:
    """digest, bytes, kept, spans (array of from, to in bytes, removed) of every distinct text; join on ``text_digest``."""
    texts = bucketed(distinct_texts(docs, text), "digest")
    runs = repeated_starts(texts, length, gram, **limits).groupBy("digest").agg(F.collect_list(F.struct("at", "n")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, spans = [], []
            for data, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                merged: list[dict] = []
                for r in sorted(found or [], key=lambda r: r["at"]):
                    a, z = r["at"], r["at"] + r["n"] - 1 + length
                    if merged and a <= merged[-1]["to"]:
                        merged[-1]["to"] = max(merged[-1]["to"], z)
                    else:
                        merged.append({"from": a, "to": z})
                edges = [0, *[e for m in merged for e in (m["from"], m["to"])], len(data)]
                out.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                spans.append(merged)
            kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), pa.array(spans, kind)], ["digest", "bytes", "kept", "spans"])

    return texts.join(runs, "digest", "left").select("digest", "bytes", "runs").mapInArrow(run, "digest binary, bytes binary, kept binary, spans array<struct<`from`:int,`to`:int>>")
