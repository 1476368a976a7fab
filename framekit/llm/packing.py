"""Sum-of-squares online packing of token sequences.

Every partition packs its own documents in one pass. A document's ids, ended by an end id, first fill whole windows
of their own; what is left, shorter than a window, is placed online: into the fill level that minimises the sum of the
squared counts of partially filled windows, kept in a level array (ties: the fullest).

Windows still open at the end, or when they hold more than ``HOLD`` ids, are closed: as many of the fullest as their ids
can fill stay as they were placed, and the pieces of the others, which may be cut freely, fill their gaps. The last
rest goes over sequences whose lengths are powers of two, which aren't padded. Thus no padding is left, and nothing is
shuffled. ``moved`` marks the pieces that left their place in this way; the number of windows open at the end hardly
depends on the partition's size, so that larger partitions have fewer.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty partition gives
none; null ids are kept; columns beyond id and text are ignored. A sequence's number is its partition's plus a count,
so equal splits of equal rows give equal packings.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import sys
import zlib
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tokenizer_path, utf8

WINDOW, END, HOLD, CACHE, SHIFT = 4096, 2, 1 << 23, 48 << 20, 33
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, moved boolean"


#: Bytes that a cached word takes besides its own and its ids'.
OBJECTS = 170
#: A word that ends in signs (without those of contractions and special tokens) after a letter or digit; they are a piece of their own.
_STOP = re.compile(rb"(.*(?:[A-Za-z0-9]|\xc3[\x9f-\xb6\xb8-\xbf]))([!-&(-/:;=?@\[-`{}~]+)", re.DOTALL)
#: A word of lower-case letters that normal forms and letter case leave alone, which is one piece.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: The same with capitals, which become lower case.
_CAPITAL = re.compile(rb"(?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Byte-level vocabularies write bytes that don't print as the characters from 256 on.
_UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_LEVEL = "".join(chr(256 + _UNPRINTED.index(b) if b in _UNPRINTED else b) for b in range(256))
#: Kinds of bytes: letters and digits a, stops and commas ., other signs !, blanks and line feeds " ", other white space t, bytes of further letters h, and X where such bytes may be of signs.
_KINDS = "".join(" " if c in " \n" else "t" if c in "\t\r\x0b\x0c" else "." if c in ".," else "a" if c.isalnum() else "!" for c in map(chr, range(128))).encode()
_KINDS += bytes(ord("h") if (0x80 <= b < 0xC0 and b not in (0x97, 0xB7)) or b == 0xC3 else ord("X") for b in range(128, 256))
_FORMATS = [f"<{n}I" for n in range(64)]


class Words(dict):
    """Ids (little-endian, four bytes each) of words, made as they are met.

    Where they take too much room, the longer half goes: short words come again more often. Words of plain letters, one piece
    each, go to the model of the vocabulary directly.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.tokenize, self.size = tokenizer, tokenizer.model.tokenize, 0

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():
            ids = self.packed([t.id for t in self.tokenize(word.decode())])
        elif _PLAIN.fullmatch(word):
            ids = self.packed([t.id for t in self.tokenize(codecs.charmap_decode(word, "strict", _BYTE_LEVEL)[0])])
        elif found := _STOP.fullmatch(word):
            ids = self[found[1]] + self[found[2]]
        elif _CAPITAL.fullmatch(word):
            ids = self[word.decode().lower().encode()]
        else:
            ids = self.packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        self[word] = ids
        self.size += OBJECTS + len(word) + len(ids)
        return ids

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(_FORMATS[len(ids)] if len(ids) < len(_FORMATS) else f"<{len(ids)}I", *ids)

    def keep_within(self, room: int) -> None:
        if self.size > room:
            by: dict[int, int] = {}
            for word, ids in self.items():
                n = len(word)
                by[n] = by.get(n, 0) + OBJECTS + n + len(ids)
            self.size, last = 0, 0
            for last in sorted(by):  # of this length some go
                if 2 * (self.size + by[last]) > room:
                    break
                self.size += by[last]
            kept = {word: ids for word, ids in self.items() if len(word) < last}
            for word, ids in self.items():
                if len(word) == last:
                    if 2 * (self.size + OBJECTS + last + len(ids)) > room:
                        break
                    self.size += OBJECTS + last + len(ids)
                    kept[word] = ids
            self.clear()
            self.update(kept)


def stops_apart(text: bytes) -> bytes:
    """A text with blanks before stops and commas that are a piece of their own: after a letter or digit, before a blank or line feed.

    Where one follows another sign, or in doubt, all stay, and words that end in signs are taken apart when they are met.
    """
    kinds = text.translate(_KINDS)
    if b"!. " in kinds or b".. " in kinds or b"X. " in kinds or b"h. " in kinds and b"X" in kinds:
        return text
    return text.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n")


def word_encoder(path: str, cache: int = CACHE) -> Callable[[list[bytes]], Iterator[bytes]]:
    """Texts to ids by a tokenizer that lower-cases and never joins what white space separates.

    Ids are looked up by word, in a cache of this process. So that words meet more often, A-Z become lower case (not in texts with
    combining marks or special tokens, where the order of steps could matter), and stops are set apart.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    # executor code is sent by value: what outlives a task is kept under a name in sys.modules
    kept = sys.modules.setdefault("_framekit_worker", ModuleType("_framekit_worker"))
    if path not in (made := kept.__dict__.setdefault("encoders", {})):
        made[path] = Words(Tokenizer.from_file(path))
    words = made[path]

    def encode(texts: list[bytes]) -> Iterator[bytes]:
        for t in texts:
            if b"\xcc" not in t and b"\xcd" not in t and b"<|" not in t:
                t = stops_apart(t.lower())
            yield b"".join(map(words.__getitem__, t.split()))
            words.keep_within(cache)

    return encode


class Levels:
    """Open windows by fill level."""

    def __init__(self, window: int = WINDOW):
        self.window, self.count, self.open, self.held = window, np.zeros(window + 1, np.int64), {}, 0

    def place(self, size: int) -> int:
        """The level, 0 for a new window, that an item of less than a window best goes to.

        With N the counts of partial levels, an item of s ids moves a window from h to h + s, which changes the sum of
        squares by 2 (N[h + s] - N[h]) + 2; a new window and one that becomes full change one count only.
        """
        n, w = self.count, self.window
        change = 2 * (n[size:w] - n[: w - size]) + 2
        change[0] = 2 * n[size] + 1
        change[1:][n[1 : w - size] == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        if n[w - size] and 1 - 2 * n[w - size] <= change[best]:
            return w - size
        return best

    def add(self, item: tuple) -> list[tuple] | None:
        """The pieces of a window that became full."""
        size = item[1]
        level = self.place(size)
        pieces = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
            self.held -= level
        pieces.append(item)
        if level + size == self.window:
            return pieces
        self.count[level + size] += 1
        self.open.setdefault(level + size, []).append(pieces)
        self.held += level + size
        return None

    def close(self) -> Iterator[list[tuple]]:
        """All open windows' pieces as whole windows and powers of two. A piece: (ids, length, document, start, moved)."""
        windows = [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]
        left = sum(level for level, _ in windows)
        stay = left // self.window
        loose = [p for _, w in windows[stay:] for p in w]
        loose.reverse()

        def take(room: int) -> Iterator[tuple]:
            while room:
                ids, size, doc, start, _ = loose.pop()
                if size > room:
                    loose.append((ids[4 * room :], size - room, doc, start + room, True))
                    ids, size = ids[: 4 * room], room
                yield ids, size, doc, start, True
                room -= size

        for level, pieces in windows[:stay]:
            yield [*pieces, *take(self.window - level)]
        left -= stay * self.window
        while left:
            size = 1 << (left.bit_length() - 1)
            yield list(take(size))
            left -= size
        self.count[:], self.open, self.held = 0, {}, 0


def pack(documents: Iterator[tuple], window: int = WINDOW, hold: int = HOLD) -> Iterator[list[tuple]]:
    """Sequences, each a list of pieces (ids, length, document, start, moved), of (document, ids)."""
    levels = Levels(window)
    for doc, ids in documents:
        n = len(ids) // 4
        for at in range(0, n - n % window, window):
            yield [(ids[4 * at : 4 * (at + window)], window, doc, at, False)]
        if rest := n % window:
            if full := levels.add((ids[4 * (n - rest) :], rest, doc, n - rest, False)):
                yield full
            if levels.held > hold:
                yield from levels.close()
    yield from levels.close()


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", folder: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row for each piece, in the columns of ``SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_path(tokenizer, folder))
        last = np.array([end], "<u4").tobytes()
        first = TaskContext.get().partitionId() << SHIFT

        def documents() -> Iterator[tuple]:
            for b in slices(batches):
                names = b.column(0).cast(pa.int64()).to_pylist()
                for name, ids in zip(names, encode(utf8(b.column(1))), strict=True):
                    ids += last
                    yield (name, len(ids) // 4), ids

        out: list[tuple] = []
        for i, pieces in enumerate(pack(documents(), window)):
            offset = 0
            for ids, size, (name, total), start, moved in pieces:
                out.append((name, start, size, zlib.crc32(ids), total, first + i, offset, moved))
                offset += size
            if len(out) >= 20_000:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)
