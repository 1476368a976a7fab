"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(keys: np.ndarray, step: int, limit: int) -> np.ndarray:
    """Positions sorted by what follows them, up to ``limit`` symbols at least."""
    return suffix_ranks(keys, step, limit)[0]


def suffix_ranks(keys: np.ndarray, step: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and for each position a rank, which those share that are equal up to the sorted depth: ``limit`` symbols, where that is ``step`` times a power of two.

    ``keys``: an integer for each position that orders suffixes by their first ``step`` symbols. Each round doubles
    the sorted depth: positions of equal rank are sorted by the rank of what follows at that depth. As in Larsson and Sadakane's
    method, only groups that aren't singletons are touched again.
    """
    n = len(keys)
    small = np.int32 if n < 1 << 31 else np.int64
    sa = np.argsort(keys, kind="stable").astype(small)
    if not n:
        return sa, sa
    ordered = keys[sa]
    heads = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    del ordered, keys
    rank = np.empty(n + 1, small)
    rank[sa], rank[n] = np.maximum.accumulate(np.where(heads, np.arange(n, dtype=small), 0)), -1
    tied = np.flatnonzero(~(heads & np.concatenate([heads[1:], [True]]))).astype(small)
    depth = step
    while depth < limit and len(tied):
        at = sa[tied]
        key = rank[at].astype(np.int64) << np.int64(32)
        key |= rank[np.minimum(at.astype(np.int64) + depth, n)] + np.int64(1)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        del order
        sa[tied] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        del key
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        depth *= 2
    return sa, rank[:n]


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; beyond the end, zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)


def common_prefixes(data: np.ndarray, sa: np.ndarray, limit: int, lanes: int = 2048) -> np.ndarray:
    """lcp[i]: length, at most ``limit``, of the common prefix of the suffixes at sa[i - 1] and sa[i]; lcp[0] = 0.

    Kasai's observation: in text order, a suffix shares with its predecessor in the array at least one symbol less than
    the suffix before it did. This needs ``sa`` in whole order: where suffixes tie at some depth, the predecessor may be any. The text is cut into ``lanes`` stretches that follow it side by side, eight bytes at a time.
    """
    n = len(data)
    lcp = np.zeros(n, np.int32)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    words = np.ndarray((n,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    stretch = -(-n // lanes)
    place = np.arange(0, n, stretch)
    h = np.zeros(len(place), np.int64)
    plcp = np.zeros(n, np.int32)
    for step in range(stretch):
        i = place + step
        if i[-1] >= n:
            place, h = place[:-1], h[:-1]
            i = place + step
            if not len(i):
                break
        j = before[i]
        h = np.where(j < 0, 0, h)
        end = np.minimum(n - np.maximum(i, j), limit)
        live = np.flatnonzero((j >= 0) & (h < end))
        while len(live):
            a, b = i[live] + h[live], j[live] + h[live]
            differ = words[a] ^ words[b]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)) // 8).astype(np.int64))
            h[live] += same
            live = live[(same == 8) & (h[live] < end[live])]
        h = np.minimum(h, end)
        plcp[i] = np.where(j < 0, 0, h)
        h = np.maximum(h - 1, 0)
    lcp[0] = 0
    return plcp[sa]
