"""Burrows-Wheeler interval expansion inside one bounded block of text."""

from __future__ import annotations

import numpy as np

_DEPTH = 8  # symbols packed into the first sort key


def suffix_order(sym: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``sym`` (uint8) sorted by their next ``depth`` symbols.

    Prefix doubling; suffixes that agree that far keep an arbitrary order.
    """
    n = len(sym)
    pad = np.zeros(n + _DEPTH, np.uint8)
    pad[:n] = sym
    key = np.zeros(n, np.uint64)
    for i in range(_DEPTH):
        key = (key << np.uint64(8)) | pad[i : i + n]
    order = np.argsort(key)
    done = _DEPTH
    while True:
        sorted_key = key[order]
        fresh = np.empty(n, bool)
        fresh[0] = False
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=fresh[1:])
        rank_sorted = np.cumsum(fresh, dtype=np.int64)
        if done >= depth or rank_sorted[-1] == n - 1:
            return order
        # only the members of tied runs need another round
        alone = fresh.copy()
        alone[0] = True
        alone[:-1] &= fresh[1:]
        open_ = np.flatnonzero(~alone)
        rank = np.zeros(n + done, np.int64)
        rank[order] = rank_sorted + 1
        members = order[open_]
        sub = (rank[members] << np.int64(32)) | rank[members + done]
        order[open_] = members[np.argsort(sub)]
        key = (rank[:n].astype(np.uint64) << np.uint64(32)) | rank[done : done + n].astype(np.uint64)
        done *= 2


def repeated_starts(sym: np.ndarray, valid: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Which positions start a string of ``length`` symbols seen twice or more.

    ``sym`` holds texts over symbols 1..255, each followed by a 0 that no
    string may contain. ``valid`` marks the positions with ``length`` symbols
    left in their text, ``weight`` how many originals a position stands for.

    Backward extension starts from the one-symbol intervals of the suffix
    order and prepends symbols breadth first, so interval ends of strings of
    1, 2, 3 ... symbols appear in that order: an end first reached at depth d
    has a longest common prefix of d - 1 with what follows. The expansion
    stops at ``length``; neighbours whose border was not reached share at
    least that many symbols.
    """
    n = len(sym)
    order = suffix_order(sym, length)
    bwt = sym[order - 1]  # order 0 wraps to the final 0
    by_symbol = np.argsort(bwt, kind="stable").astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[by_symbol] = np.arange(n, dtype=np.int32)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    after = np.full(n, n, np.int32)
    before = np.full(n, -1, np.int32)
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    inner = bwt != 0

    counts = np.bincount(sym, minlength=256)
    ends = np.cumsum(counts)
    present = np.flatnonzero(counts[1:]) + 1
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    border[counts[0]] = True
    border[ends[present]] = True
    lb, rb = (ends[present] - counts[present]).astype(np.int32), (ends[present] - 1).astype(np.int32)
    for _ in range(length - 1):
        if not len(lb):
            break
        one = lb == rb
        p = lb[one]
        p = lf[p[inner[p]]]
        lb, rb = lb[~one], rb[~one]
        size = rb - lb + 1
        row = np.repeat(np.arange(len(lb), dtype=np.int32), size)
        at = np.arange(len(row), dtype=np.int32) + (lb - (np.cumsum(size, dtype=np.int32) - size))[row]
        keep = inner[at]
        at, row = at[keep], row[keep]
        first = np.sort(lf[at[before[at] < lb[row]]])
        last = np.sort(lf[at[after[at] > rb[row]]])
        new = ~border[last + 1]
        lb, rb = first[new], last[new]
        p = p[~border[p + 1]]
        border[rb + 1] = True
        border[p + 1] = True
        lb, rb = np.concatenate([lb, p]), np.concatenate([rb, p])
    # neighbours in suffix order without a border between them are one class
    ok = valid[order]
    joined = ~border[1:n] & ok[:-1]
    again = np.zeros(n, bool)
    again[1:] |= joined
    again[:-1] |= joined
    again |= weight[order] >= 2
    out = np.zeros(n, bool)
    out[order] = again & ok
    return out
