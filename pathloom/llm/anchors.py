"""Content-chosen anchors: which windows of a text can be compared at all.

Every window of ``length`` bytes is given one anchor, the first smallest hash among the
short runs of bytes that start in the first ``REACH`` bytes of it.  Equal windows have
their anchors at the same distance from their starts.  The bytes that all windows of an
anchors share, :func:`core` bytes from the anchor on, name it; windows can be equal only if
their anchors have equal names.
"""

from __future__ import annotations

import numpy as np

from .common import byte_table, mix, powers

#: Usual length of the windows, bytes in which an anchor is looked for, bytes hashed for that.
LENGTH = 400
REACH = 96
GRAM = 8
_U = np.uint64


def core(length: int) -> int:
    """Bytes that all windows of ``length`` bytes with the same anchor have in common."""
    return length - REACH + 1


def _prefix(data: np.ndarray, seed: int) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(byte_table(seed)[data] * up[: len(data)], out=out[1:])
    return out


def _spans(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(_U))


def find(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For the rows that ``ends`` cuts ``data`` into: row, place of the anchor, its first
    and last window start (all in ``data``), two hashes of the name, and a hash of all
    bytes that its windows cover."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(ends)
    rows = np.flatnonzero(sizes >= length)
    if not len(rows):
        return none, none, none, none, none.view(_U), none.view(_U), none.view(_U)
    starts = np.repeat(ends[rows], sizes[rows] - length + 1)
    first = np.concatenate([[0], np.cumsum(sizes[rows] - length + 1)])[:-1]
    window = starts + np.arange(len(starts)) - np.repeat(first, sizes[rows] - length + 1)
    n = len(data) - GRAM + 1
    gram = np.zeros(n, _U)
    table = byte_table(3)
    for i in range(GRAM):  # a short polynomial, so that the order of the hashes is arbitrary
        gram = gram * _U(0x9E3779B97F4A7C15) + table[data[i : i + n]]
    key = (mix(gram) & ~_U((1 << 32) - 1)) | np.arange(n, dtype=_U)
    width = 1
    while 2 * width <= REACH:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if width < REACH:
        key = np.minimum(key[: len(key) - (REACH - width)], key[REACH - width :])
    place = (key[window] & _U((1 << 32) - 1)).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    at = np.flatnonzero(new)
    low, high, place = window[at], window[np.append(at[1:], len(window)) - 1], place[at]
    one, two = _prefix(data, 21), _prefix(data, 22)
    whole = mix(_spans(one, low, high + length) + mix((place - low).astype(_U) * _U(512) + (high - low).astype(_U)))
    return np.searchsorted(ends, place, "right") - 1, place, low, high, _spans(one, place, place + core(length)), _spans(two, place, place + core(length)), whole
