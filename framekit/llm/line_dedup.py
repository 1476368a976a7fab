"""Line deduplication with sharded cuckoo filters over exact reference counts.

A line's key is the line stripped of ASCII white space, A-Z in lower case; it is kept as a 128-bit hash. The reference
counts say in how many documents each key occurs. They are exact and additive, so that documents can be inserted and
deleted again (``change``), and they are dealt to shards by the key's leading bits. A key in at least
``min_docs`` documents is hot. Each shard has a cuckoo filter of its hot keys, which supports insertion and deletion
too (``refresh``), and a list of the shard's other known keys that the filter would wrongly report; with it the
filter's answer is exact for every counted key.

Filters stay where they are. Each row's different keys go to their shards' filters, a shard with many lines having several copies
of its filter for ``PROBE_ROWS`` lines each, and the hot ones come back to their row. Rows and lists of hot keys
meet by a 64-bit hash of id and text: should two rows share it, either list holds the other's hot keys too, which
changes nothing, as a hot key is hot everywhere.

Defined results: a null text counts as one empty line; empty keys are never hot; repeated rows count as documents of
their own; null ids are kept; an empty table gives an empty table; other columns are kept, ``n_chars`` (if there) follows
the text; names that begin with two underscores are reserved.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, cut, partitions, slices, utf8

MIN_DOCS, SHARD_KEYS, PROBE_ROWS = 10, 1 << 16, 20_000
SLOTS, KICKS = 4, 500


def keys_of(text: bytes) -> list[bytes]:
    return [line.strip(SPACE_BYTES) for line in text.lower().split(b"\n")]


def digests(keys: list[bytes]) -> np.ndarray:
    """An (n, 2) array of the halves of the keys' 128-bit hashes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)


class CuckooFilter:
    """Buckets of four 16-bit marks; a key's two buckets are each other's image under its mark."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, len(hashes)) / (SLOTS * 0.84)))))
        while True:
            made = cls(np.zeros((buckets, SLOTS), np.uint16))
            if all(made.insert(int(h), int(low)) for h, low in hashes):
                return made
            buckets *= 2

    @staticmethod
    def mark(low):
        return low % np.uint64(65535) + np.uint64(1)

    @staticmethod
    def image(mark):
        return (mark * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)

    def places(self, high: int, low: int) -> tuple[int, int, int]:
        mask, mark = len(self.table) - 1, low % 65535 + 1
        first = high & mask
        return mark, first, first ^ (((mark * 0x9E3779B97F4A7C15) % (1 << 64) >> 24) & mask)

    def insert(self, high: int, low: int) -> bool:
        """False if no place was found; the filter then has to grow."""
        mark, a, b = self.places(high, low)
        mask, at = len(self.table) - 1, a
        for at in (a, b):
            if len(free := np.flatnonzero(self.table[at] == 0)):
                self.table[at, free[0]] = mark
                return True
        for kick in range(KICKS):
            slot = (kick * 7 + mark) % SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at ^= ((mark * 0x9E3779B97F4A7C15) % (1 << 64) >> 24) & mask
            if len(free := np.flatnonzero(self.table[at] == 0)):
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, high: int, low: int) -> bool:
        mark, a, b = self.places(high, low)
        for at in (a, b):
            if len(held := np.flatnonzero(self.table[at] == mark)):
                self.table[at, held[0]] = 0
                return True
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.table) - 1)
        mark = self.mark(hashes[:, 1])
        first = hashes[:, 0] & mask
        other = first ^ (self.image(mark) & mask)
        return (self.table[first] == mark[:, None]).any(axis=1) | (self.table[other] == mark[:, None]).any(axis=1)


def reference_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """high, low, n_docs: in how many rows of ``docs`` each key occurs. Summed in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            seen: Counter = Counter()
            for t in utf8(b.column(0)):
                seen.update(set(keys_of(t)))
            seen.pop(b"", None)
            d = digests(list(seen)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(list(seen.values()), pa.int64())], ["high", "low", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "high long, low long, n long").groupBy("high", "low").agg(F.sum("n").alias("n_docs"))


def change(counts: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The counts after documents came or went; keys that no document has any more are dropped."""
    parts = [counts]
    if inserted is not None:
        parts.append(reference_counts(inserted, text))
    if deleted is not None:
        parts.append(reference_counts(deleted, text).withColumn("n_docs", -F.col("n_docs")))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("high", "low").agg(F.sum("n_docs").alias("n_docs")).where("n_docs <> 0")


def _shard(bits: int):
    return F.shiftrightunsigned(F.col("high"), 64 - bits).cast("int") if bits else F.lit(0)


def build_filters(counts: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, int]:
    """A row for each shard that has hot keys: shard, filter, wrong (the other keys that it reports, 16 bytes each);
    and the number of leading bits that name a shard. Shards hold up to ``SHARD_KEYS`` keys on average, and are at least as many as a
    shuffle has partitions."""
    bits = int(np.ceil(np.log2(max(partitions(counts), counts.count() / SHARD_KEYS))))

    def run(t: pa.Table) -> pa.Table:
        h = np.stack([t["high"].to_numpy().view(np.uint64), t["low"].to_numpy().view(np.uint64)], axis=1)
        hot = t["n_docs"].to_numpy() >= min_docs
        if not hot.any():
            return pa.table({"shard": pa.array([], pa.int32()), "filter": pa.array([], pa.binary()), "wrong": pa.array([], pa.binary())})
        made = CuckooFilter.of(h[hot])
        wrong = h[~hot][made.contains(h[~hot])]
        return pa.table({"shard": pa.array([t["shard"][0].as_py()], pa.int32()), "filter": pa.array([made.table.tobytes()], pa.binary()), "wrong": pa.array([wrong.astype(">u8").tobytes()], pa.binary())})

    return counts.withColumn("shard", _shard(bits)).groupBy("shard").applyInArrow(run, "shard int, filter binary, wrong binary"), bits


def refresh(filters: DataFrame, bits: int, before: DataFrame, after: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The filters after a change of counts: keys that became hot are inserted, keys that are no longer are deleted.

    The lists of wrong reports are made anew from the shard's counts. Only shards with a change are rebuilt; a
    filter that overflows is made anew, larger.
    """
    old, new = (x.select("high", "low", F.col("n_docs").alias(name)) for x, name in ((before, "b"), (after, "a")))
    both = old.join(new, ["high", "low"], "full").withColumn("shard", _shard(bits))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        h = np.stack([right["high"].to_numpy().view(np.uint64), right["low"].to_numpy().view(np.uint64)], axis=1)
        was, now = ((np.asarray(right[c].fill_null(0)) >= min_docs) for c in ("b", "a"))
        if left.num_rows:
            made = CuckooFilter(np.frombuffer(left["filter"][0].as_py(), np.uint16).reshape(-1, SLOTS).copy())
            for high, low in h[was & ~now]:
                made.delete(int(high), int(low))
            if not all(made.insert(int(high), int(low)) for high, low in h[now & ~was]):
                made = CuckooFilter.of(h[now])
        else:
            made = CuckooFilter.of(h[now])
        wrong = h[~now][made.contains(h[~now])] if len(h) else h
        rows = int(now.any())
        return pa.table({"shard": pa.array([key[0].as_py()] * rows, pa.int32()), "filter": pa.array([made.table.tobytes()] * rows, pa.binary()), "wrong": pa.array([wrong.astype(">u8").tobytes()] * rows, pa.binary())})

    return filters.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(run, "shard int, filter binary, wrong binary")


def reported(filter_: bytes, wrong: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the shard's counted keys, as (n, 2) hashes, are hot."""
    found = CuckooFilter(np.frombuffer(filter_, np.uint16).reshape(-1, SLOTS)).contains(hashes)
    not_hot = {wrong[i : i + 16] for i in range(0, len(wrong), 16)}
    for i in np.flatnonzero(found) if not_hot else ():
        found[i] = hashes[i].astype(">u8").tobytes() not in not_hot
    return found


def hot_keys(rows: DataFrame, counts: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """__row, __hot (array of keys, 16 bytes each) of each of ``rows`` (__row, text) that has hot keys, by probing the filters."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = [set(keys_of(t)) - {b""} for t in utf8(b.column(1))]
            d = digests([k for ks in keys for k in ks]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(k) for k in keys])), pa.array(d[:, 0]), pa.array(d[:, 1])], ["__row", "high", "low"])

    def probe(lines: pa.Table, own: pa.Table) -> pa.Table:
        h = np.stack([lines["high"].to_numpy().view(np.uint64), lines["low"].to_numpy().view(np.uint64)], axis=1)
        found = reported(own["filter"][0].as_py(), own["wrong"][0].as_py(), h) if own.num_rows else np.zeros(len(h), bool)
        raw = h[found].astype(">u8").tobytes()
        return pa.table({"__row": lines["__row"].filter(pa.array(found)).combine_chunks(), "key": pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())})

    load = counts.groupBy(_shard(bits).alias("shard")).agg(F.ceil(F.sum("n_docs") / PROBE_ROWS).cast("int").alias("copies"))
    held = cut(filters.join(load, "shard"), "held")
    lines = rows.mapInArrow(occurrences, "__row long, high long, low long").withColumn("shard", _shard(bits))
    lines = lines.join(held.select("shard", "copies"), "shard").withColumn("copy", F.pmod(F.xxhash64("__row"), F.col("copies")).cast("int")).drop("copies")
    copied = held.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    found = lines.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInArrow(probe, "__row long, key binary")
    return found.groupBy("__row").agg(F.collect_set("key").alias("__hot"))


def _replaced(b: pa.RecordBatch, new: dict[str, pa.Array], names: list[str]) -> pa.RecordBatch:
    old = {n: b.column(i) for i, n in enumerate(b.schema.names)}
    return pa.RecordBatch.from_arrays([(old | new)[n] for n in names], names)


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, lines: str = "n_lines", dropped: str = "n_dropped", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without their hot lines, with the number of lines before and of lines dropped.

    ``lines`` and ``dropped`` name the added columns and replace columns of these names. ``doc_id``, where there is such a
    column, only spreads rows of equal texts.
    """
    counts = cut(reference_counts(docs, text), "counts")
    filters, bits = build_filters(counts, min_docs)
    kept_columns = [f for f in docs.schema.fields if f.name not in (lines, dropped)]
    names = [f.name for f in kept_columns] + [lines, dropped]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_columns) + f", `{lines}` long, `{dropped}` long"
    row = F.xxhash64(F.col(text), *[F.col(c) for c in docs.columns if c == doc_id])
    hot = hot_keys(docs.select(row.alias("__row"), F.col(text).cast("string")), counts, filters, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out, n, gone = [], [], []
            for t, hot in zip(utf8(b.column(b.schema.get_field_index(text))), b.column(b.schema.get_field_index("__hot")).to_pylist(), strict=True):
                stay = all_lines = t.split(b"\n")
                if hot:
                    own = set(hot)
                    stay = [line for line, k in zip(all_lines, keys_of(t), strict=True) if not k or xxhash.xxh3_128_digest(k) not in own]
                out.append(t if stay is all_lines else b"\n".join(stay))
                n.append(len(all_lines))
                gone.append(len(all_lines) - len(stay))
            made = pa.array(out, pa.binary()).cast(pa.string())
            new = {text: made, lines: pa.array(n, pa.int64()), dropped: pa.array(gone, pa.int64())}
            if "n_chars" in names and text != "n_chars":
                new["n_chars"] = pc.utf8_length(made).cast(b.schema.field("n_chars").type)
            yield _replaced(b, new, names)

    return docs.select([f.name for f in kept_columns]).withColumn("__row", row).join(hot, "__row", "left").drop("__row").mapInArrow(run, schema)
