"""Suffix arrays of one shard: Larsson-Sadakane refinement, Kasai's common prefixes, and binary search, in numpy.

All of them look at the first `depth` bytes of a suffix; a text is padded by zero bytes past its end.
"""

from __future__ import annotations

import numpy as np


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at each position as one big-endian number, past the end too."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    out = np.zeros(len(text) + depth + 8, np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(out)]
    return out


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of the first `depth` bytes of their suffixes, group number of each position).
    Suffixes alike up to depth share a group.

    Groups of suffixes that are alike in h bytes are refined by the groups of the suffixes h further on, which
    doubles h; only groups of more than one are sorted again. A group's number is the place of its last entry."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = min(8, depth)
    key = _words(text, depth)[:n] >> np.uint64(8 * (8 - h))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    rank = np.zeros(n + depth + 1, np.int64)  # past the end every suffix is alike, and first
    fresh = np.r_[ranked[1:] != ranked[:-1], True]
    last = np.flatnonzero(fresh)
    rank[order] = np.repeat(last, np.diff(np.r_[-1, last])) + 1
    open_ = np.flatnonzero(~(fresh & np.r_[True, fresh[:-1]]))  # places in groups of more than one
    while h < depth and len(open_):
        step = min(h, depth - h)
        own = order[open_]
        first, second = rank[own], rank[own + step]
        inner = np.argsort(first * (n + 2) + second, kind="stable")
        own, first, second = own[inner], first[inner], second[inner]
        order[open_] = own
        fresh = np.r_[(first[1:] != first[:-1]) | (second[1:] != second[:-1]), True]
        last = np.flatnonzero(fresh)
        rank[own] = np.repeat(open_[last], np.diff(np.r_[-1, last])) + 1
        open_ = open_[~(fresh & np.r_[True, fresh[:-1]])]
        h += step
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int, stride: int = 16) -> np.ndarray:
    """For each place in order, the bytes (depth at most) that its suffix shares with the one before it.

    Suffixes of one group share depth bytes. For the others Kasai's rule holds: the suffix one byte further on
    shares at least one byte less with its own predecessor. Every stride-th position is compared from the
    start; the rest go on from what the rule grants them."""
    n = len(text)
    words = _words(text, depth)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)

    def extend(at: np.ndarray) -> None:
        at = at[before[at] >= 0]
        while len(at):
            done = shared[at]
            differ = words[at + done] ^ words[before[at] + done]
            same = np.full(len(at), 8, np.int64)
            some = differ != 0
            # the leading zero bytes of the difference
            top = differ[some]
            lead = np.zeros(len(top), np.int64)
            for k in range(8):
                lead += top < (np.uint64(1) << np.uint64(8 * (7 - k)))
            same[some] = lead
            shared[at] = np.minimum(done + same, np.minimum(depth, n - np.maximum(at, before[at])))
            at = at[(same == 8) & (shared[at] == done + 8) & (shared[at] < depth)]

    tied = order[1:][group[order[1:]] == group[order[:-1]]]
    shared[tied] = np.minimum(depth, n - np.maximum(tied, before[tied]))
    open_ = np.ones(n, bool)
    open_[tied] = False
    anchor = np.arange(n) % stride == 0
    extend(np.flatnonzero(anchor & open_))
    granted = np.repeat(np.where(open_[anchor], shared[anchor], 0), stride)[:n] - np.arange(n) % stride
    rest = np.flatnonzero(~anchor & open_)
    shared[rest] = np.where(before[rest] >= 0, np.maximum(granted[rest], 0), 0)
    extend(rest)
    return shared[order]


def find(text: np.ndarray, order: np.ndarray, other: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each start in other, the first place in order (positions of text, sorted by their first depth bytes)
    whose depth bytes are the same; -1 where there is none. A binary search for all starts at once."""
    a, b = _words(text, depth), _words(other, depth)
    steps = [min(k, depth - 8) for k in range(0, depth, 8)]
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)

    def less(places: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order's suffix is smaller, it is the same) for each pair."""
        smaller, alive = np.zeros(len(which), bool), np.arange(len(which))
        for k in steps:
            x, y = a[order[places[alive]] + k], b[starts[which[alive]] + k]
            smaller[alive[x < y]] = True
            alive = alive[x == y]
            if not len(alive):
                break
        same = np.zeros(len(which), bool)
        same[alive] = True
        return smaller, same

    todo = np.arange(len(starts))
    while len(todo := todo[low[todo] < high[todo]]):
        middle = (low[todo] + high[todo]) >> 1
        smaller, _ = less(middle, todo)
        low[todo[smaller]] = middle[smaller] + 1
        high[todo[~smaller]] = middle[~smaller]
    within = np.flatnonzero(low < len(order))
    out = np.full(len(starts), -1, np.int64)
    if len(within):
        _, same = less(low[within], within)
        out[within[same]] = low[within[same]]
    return out
