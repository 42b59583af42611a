"""Burrows-Wheeler transforms of string collections, and merging them.

A collection is one array of symbols in which every string ends with symbol 0; the end
of a string is smaller than any symbol, and of two ends the earlier string's is smaller.

Merging doesn't sort suffixes again: it refines, step by step, the order in which the rows
of the shards' transforms interleave.  After ``h`` steps the interleave is right for the
first ``h`` symbols of the suffixes, and rows that agree in them form a block; where a
block breaks first is where the common prefix ends.  Blocks of two rows or more after
``h`` steps are the repeated intervals of length ``h``.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of a collection in order, by prefix doubling."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    end = symbols == 0
    rank = symbols.astype(np.int64) + int(end.sum())
    rank[end] = np.arange(int(end.sum()))  # ends differ: a suffix is decided at its end
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        new = np.ones(n, bool)
        ranked = rank[order]
        new[1:] = ranked[1:] != ranked[:-1]
        if width > 1:
            ahead = second[order]
            new[1:] |= ahead[1:] != ahead[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if rank[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] if width < n else 0
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # places whose suffix is not alone yet
        who = order[open_]
        key = rank[who] * np.int64(n) + second[who]
        order[open_] = who[np.argsort(key, kind="stable")]
        width *= 2


def transform(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The symbol before every suffix (0 before the start of a string)."""
    return np.where(order > 0, symbols[order - 1], 0).astype(symbols.dtype)


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the transforms of shards: for every merged row its shard, and its block
    of rows that agree in the first ``depth`` symbols (an end agrees with nothing)."""
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    ends = np.repeat(np.arange(len(transforms), dtype=np.uint8), [int((t == 0).sum()) for t in transforms])
    k = len(ends)
    block = np.zeros(len(shard), np.int32)
    symbols = np.empty(len(shard), transforms[0].dtype if transforms else np.uint16)
    for _ in range(depth):
        for z, t in enumerate(transforms):
            symbols[shard == z] = t
        order = np.argsort(symbols, kind="stable")
        sorted_, came = symbols[order], block[order]
        shard = shard[order]
        shard[:k] = ends
        new = np.ones(len(shard), bool)
        new[1:] = (sorted_[1:] != sorted_[:-1]) | (came[1:] != came[:-1])
        new[:k] = True
        if k < len(new):
            new[k] = True
        block = np.cumsum(new, dtype=np.int32) - 1
    return shard, block


def repeats(shards: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """For every shard, which of its places start ``depth`` symbols (without an end) that
    start at another place of some shard too."""
    orders = [suffix_array(s) for s in shards]
    shard, block = merge([transform(s, o) for s, o in zip(shards, orders, strict=True)], depth)
    size = np.bincount(block, minlength=1)
    again = size[block] > 1
    out = []
    for z, (s, o) in enumerate(zip(shards, orders, strict=True)):
        found = np.zeros(len(s), bool)
        found[o] = again[shard == z]
        out.append(found)
    return out
