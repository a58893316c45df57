"""Suffix arrays to a set depth by Larsson-Sadakane refinement, and Kasai's common prefixes, in numpy.

Both work on segments of bytes laid one after another; a suffix ends with its segment.
"""

from __future__ import annotations

import numpy as np


def suffix_ranks(data: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first `depth` bytes: the place where its group of equal ones begins in sorted order.

    `left` is the number of bytes from each place to the end of its segment. The first sort takes seven bytes; then
    only groups of more than one suffix are sorted on, by the rank of the suffix that begins where the known part
    ends, which doubles it.
    """
    n = len(data)
    known = min(7, depth)
    key = np.zeros(n, np.uint64)
    for k in range(known):  # nine bits each: 0 is the end of the segment
        symbol = np.zeros(n, np.uint64)
        symbol[:n - k] = data[k:].astype(np.uint64) + np.uint64(1)
        symbol[left <= k] = 0
        key = (key << np.uint64(9)) | symbol
    places = np.argsort(key).astype(np.int32)
    rank = np.empty(n, np.int32)
    key = key[places]
    rank[places], groups = _ranks(key[1:] != key[:-1], n)
    open_ = places[groups > 1]
    del key, places, groups
    while known < depth and len(open_):
        ahead = min(known, depth - known)  # the last step overlaps what is known
        # Ranks of a suffix that is over are below all others.
        far = np.where(left[open_] > ahead, rank[np.minimum(open_ + ahead, n - 1)] + 1, 0)
        base = rank[open_]
        order = np.argsort((base.astype(np.uint64) << np.uint64(32)) | far.astype(np.uint64))
        open_, base, far = open_[order], base[order], far[order]
        new_group = np.ones(len(open_), bool)
        new_group[1:] = base[1:] != base[:-1]
        new = new_group.copy()
        new[1:] |= far[1:] != far[:-1]
        at = np.arange(len(open_), dtype=np.int32)
        group_start = np.maximum.accumulate(np.where(new_group, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        size = np.diff(np.append(np.flatnonzero(new), len(open_)))
        rank[open_] = base + start - group_start
        open_ = open_[np.repeat(size, size) > 1]
        known += ahead
    return rank


def _ranks(new: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted values: where each one's group of equal ones begins, and the size of the group."""
    starts = np.flatnonzero(np.concatenate([[True], new])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n)).astype(np.int32)
    return np.repeat(starts.astype(np.int32), sizes), np.repeat(sizes, sizes)


def suffix_array(data: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes in order of their first `depth` bytes; equal ones by place."""
    rank = suffix_ranks(data, left, depth).astype(np.int64) << 32
    rank |= np.arange(len(rank))
    return np.argsort(rank).astype(np.int32)


def common_prefixes(data: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each entry of the suffix array, how many bytes it shares with the one before, `depth` at most.

    Kasai's observation, taken for all places at once: if a suffix and the one before it in order are both one byte
    on from such a pair, they share one byte less than that pair. Where that pair shared all `depth` bytes, the one
    byte at the end of the depth tells whether these do as well. Only other pairs are compared from the beginning.
    """
    n = len(order)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    one_on = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    follows[1:] = one_on & (left[1:] == left[:-1] - 1) & (left[before[1:]] == left[before[:-1]] - 1)
    words = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8).copy().view("<u8")[:, 0]
    shared = np.zeros(n, np.int32)
    heads = np.flatnonzero(~follows & (before >= 0))
    shared[heads] = _compared(words, left, heads, before[heads], depth)
    del heads, one_on
    # In a run of pairs that follow one another, the first that tells where the common bytes end.
    i = np.flatnonzero(follows).astype(np.int32)
    j = before[i]
    whole = (left[i] >= depth) & (left[j] >= depth)
    whole[whole] = data[i[whole] + depth - 1] == data[j[whole] + depth - 1]
    tells = ~follows & (shared < depth)
    tells[i[~whole]] = True
    shared[i] = depth - 1
    del i, j, whole
    at = np.arange(n, dtype=np.int32)
    head = np.maximum.accumulate(np.where(follows, np.int32(0), at))
    first = np.full(n, n, np.int32)
    places = np.flatnonzero(tells).astype(np.int32)
    np.minimum.at(first, head[places], places)
    first = first[head]
    del head, places, tells
    told = follows & (first <= at)
    derived = np.where(told, shared[np.minimum(first, n - 1)] - (at - first), depth)
    shared = np.where(follows, derived, shared)
    again = np.flatnonzero(follows & (derived < 0))  # beyond a pair that shared nothing
    shared[again] = _compared(words, left, again, before[again], depth)
    return shared[order]


def _compared(words: np.ndarray, left: np.ndarray, p: np.ndarray, q: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes the suffixes at `p` and `q` share, eight at a time."""
    limit = np.minimum(np.minimum(left[p], left[q]), depth)
    out = limit.copy()
    active = np.arange(len(p))
    done = 0
    while len(active):
        differ = words[p[active] + done] ^ words[q[active] + done]
        ends = np.flatnonzero(differ)
        if len(ends):
            lowest = differ[ends] & (~differ[ends] + np.uint64(1))
            found = done + np.log2(lowest.astype(np.float64)).astype(np.int64) // 8
            out[active[ends]] = np.minimum(found, limit[active[ends]])
        done += 8
        active = active[(differ == 0) & (limit[active] > done)]
    return out
