"""Edit-aware token counts.

A document is a sequence of units, each white space with the word after it; the byte-level pattern of the vocabulary
never joins what lies on both sides of a unit's start, so counts add up over units. The units are grouped into leaves of about
``LEAF`` characters, and a segment tree holds the leaves' sums. An edit re-encodes the leaves it touches and those next to
them, whose boundary an edit can move, and updates the sums above. Whole texts are never encoded again.

Defined results: a null or empty text has no units and 0 tokens; edits out of range are clipped to the text; null ids are
kept; repeated rows are counted each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tokenizer_path

LEAF, CACHE = 256, 400_000
#: White space as ASCII has it, so that a unit starts only where the vocabulary's pattern starts a piece too.
_UNIT = re.compile(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$")

_BOUNDARY = re.compile(r"(?<=[^ \t\n\x0b\x0c\r])(?=[ \t\n\x0b\x0c\r])")


def unit_counter(path: str, cache: int = CACHE) -> Callable[[str], int]:
    """Number of tokens of a text, summed over its units. Counts of units are cached, and the cache starts anew when full."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, int] = {}
    encode = encoding.encode_ordinary

    class Counts(dict):
        def __missing__(self, unit: str) -> int:
            if len(self) > cache:
                self.clear()
            n = self[unit] = len(encode(unit))
            return n

    known = Counts()
    return lambda text: sum(map(known.__getitem__, _UNIT.findall(text)))


class TokenTree:
    """A document's leaves and the sums over them, with edits."""

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF):
        self.count, self.leaf, self.encoded = count, leaf, 0
        self._build(self._split(text))

    def _split(self, text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            # the first unit's start at or after the leaf's size: white space after a word
            found = _BOUNDARY.search(text, min(len(text), at + self.leaf))
            end = found.start() if found else len(text)
            out.append(text[at:end])
            at = end
        return out

    def _encode(self, leaf: str) -> int:
        self.encoded += len(leaf)
        return self.count(leaf)

    def _build(self, leaves: list[str], known: dict[int, int] | None = None) -> None:
        self.leaves = leaves
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.tokens = [0] * (2 * self.width)
        self.chars = [0] * (2 * self.width)
        for i, leaf in enumerate(leaves):
            self.tokens[self.width + i] = known[i] if known and i in known else self._encode(leaf)
            self.chars[self.width + i] = len(leaf)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1] if self.leaves else 0

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and its start; the last leaf for the end."""
        node, start = 1, 0
        while node < self.width:
            left = self.chars[2 * node]
            if at < start + left:
                node = 2 * node
            else:
                node, start = 2 * node + 1, start + left
        i = min(node - self.width, len(self.leaves) - 1)
        return i, start if i == node - self.width else self.chars[1] - len(self.leaves[-1])

    def edit(self, at: int, removed: int, added: str) -> None:
        """Replace ``removed`` characters from ``at`` on by ``added``."""
        size = self.chars[1] if self.leaves else 0
        at = min(max(0, at), size)
        removed = min(max(0, removed), size - at)
        if not self.leaves:
            self._build(self._split(added))
            return
        first, _ = self.find(max(0, at - 1))
        last, _ = self.find(min(size - 1, at + removed))
        first, last = max(0, first - 1), min(len(self.leaves) - 1, last + 1)
        start = self._start(first)
        old = "".join(self.leaves[first : last + 1])
        new = self._split(old[: at - start] + added + old[at - start + removed :])
        if len(new) == last - first + 1:
            for i, leaf in enumerate(new, first):
                self._set(i, leaf)
            return
        known = {i: self.tokens[self.width + i] for i in range(first)}
        shift = len(new) - (last - first + 1)
        known |= {i + shift: self.tokens[self.width + i] for i in range(last + 1, len(self.leaves))}
        self._build(self.leaves[:first] + new + self.leaves[last + 1 :], known)

    def _start(self, leaf: int) -> int:
        """Characters before a leaf, from the sums on its path."""
        node, n = self.width + leaf, 0
        while node > 1:
            if node & 1:
                n += self.chars[node - 1]
            node >>= 1
        return n

    def _set(self, i: int, leaf: str) -> None:
        node = self.width + i
        if leaf != self.leaves[i]:
            self.leaves[i] = leaf
            self.tokens[node], self.chars[node] = self._encode(leaf), len(leaf)
            node >>= 1
            while node:
                self._sum(node)
                node >>= 1


def counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: Callable[[str], list[tuple[int, int, str]]] | None = None, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, n_leaves and, after ``edits`` (of a text: at, removed, added), edited_tokens, edited_chars and encoded_chars (characters encoded for the edits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = unit_counter(tokenizer_path(vocabulary, folder))
        for b in slices(batches):
            rows = []
            for t in b.column(1).to_pylist():
                tree = TokenTree(t or "", count, leaf)
                tokens, leaves, tree.encoded = tree.total, len(tree.leaves), 0
                for edit in edits(t or "") if edits else []:
                    tree.edit(*edit)
                rows.append((tokens, leaves, tree.total, tree.chars[1] if tree.leaves else 0, tree.encoded))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "n_tokens", "n_leaves", "edited_tokens", "edited_chars", "encoded_chars"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_leaves long, edited_tokens long, edited_chars long, encoded_chars long")
