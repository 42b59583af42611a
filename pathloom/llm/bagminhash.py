"""BagMinHash signatures of multisets of word shingles, as array code.

A multiset gives each element an integer weight (its count).  The weight axis is cut
into the dyadic intervals [0, 1), [1, 2), [2, 4), [4, 8), ...; each (element, interval)
owns a Poisson process in time whose rate is the interval's size.  Every point falls on
a component of the signature and on a level inside the interval, both by hash, and
counts for a multiset only if the level is below the element's weight.  A component's
value is the time of its first point.  Two multisets agree in a component with
probability sum(min) / sum(max) of their weights, the weighted Jaccard similarity;
the work per element grows with the logarithm of its weight.
"""

from __future__ import annotations

import numpy as np

from .common import mix, prefix_hash, span_hash, word_spans

_U = np.uint64
#: Words in a shingle.
SHINGLE = 5


def shingles(data: np.ndarray, ends: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each row, in order, and their rows.  A row of
    fewer words than ``k`` (but some) has one shingle, all its words."""
    starts, stops, row = word_spans(data, ends)
    words = span_hash(prefix_hash(data, 7), starts, stops)
    n = len(words)
    if n >= k:
        whole = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
        h = np.zeros(len(whole), _U)
        for i in range(k):
            h = mix(h * _U(0x9FB21C651E98DF25) + words[whole + i])
        rows = row[whole]
    else:
        h, rows = np.zeros(0, _U), np.zeros(0, np.int64)
    counts = np.bincount(row, minlength=len(ends) - 1)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])[short]
        extra = np.zeros(len(short), _U)
        for i in range(k - 1):
            has = counts[short] > i
            extra[has] = mix(extra[has] * _U(0x9FB21C651E98DF25) + words[first[has] + i])
        extra = mix(extra + counts[short].astype(_U))
        h, rows = np.concatenate([h, extra]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        h, rows = h[order], rows[order]
    return h, rows


def bags(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, element) with counts, by row and then element."""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return h[at], rows[at], np.diff(np.append(at, len(h)))


def signatures(element: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """The (n_rows, m) first-point times; infinite only for rows without elements."""
    sig = np.full(n_rows * m, np.inf)
    worst = np.full(n_rows, np.inf)
    e, r, low, size, w = [], [], [], [], []
    k, left = 0, np.ones(len(element), bool)
    while left.any():  # one turn for each dyadic interval that some weight reaches
        lo, sz = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
        left = weight > lo
        if not left.any():
            break
        e.append(mix(element[left] + _U(k + 1)))
        r.append(row[left])
        w.append(weight[left])
        low.append(np.full(int(left.sum()), lo, np.int64))
        size.append(np.full(int(left.sum()), sz, np.int64))
        k += 1
    if not e:
        return sig.reshape(n_rows, m)
    e, r, low, size, w = (np.concatenate(x) for x in (e, r, low, size, w))
    t = np.zeros(len(e))
    while len(e):
        e = mix(e + _U(0x9E3779B97F4A7C15))
        u = ((e >> _U(11)).astype(np.float64) + 1) * 2.0**-53
        t = t - np.log(u) / size
        keep = t < worst[r]
        e, r, low, size, w, t = (x[keep] for x in (e, r, low, size, w, t))
        if not len(e):
            break
        place = mix(e ^ _U(0xA0761D6478BD642F))
        level = low + ((place >> _U(32)).astype(np.int64) & (size - 1))
        hit = level < w
        at = r[hit] * m + (place[hit] % _U(m)).astype(np.int64)
        np.minimum.at(sig, at, t[hit])
        touched = np.unique(r)
        worst[touched] = sig.reshape(n_rows, m)[touched].max(axis=1)
    return sig.reshape(n_rows, m)


def band_keys(sig: np.ndarray, bands: int, rows_per_band: int) -> np.ndarray:
    """(n_rows, bands) keys: rows that agree in all components of a band share its key."""
    parts = sig.view(_U).reshape(len(sig), bands, rows_per_band)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U)), (len(sig), bands)).copy()
    for i in range(rows_per_band):
        key = mix(key * _U(0x9FB21C651E98DF25) + parts[:, :, i])
    return key


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sum of minima and sum of maxima of two bags of (sorted elements, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    return low, int(a[1].sum() + b[1].sum()) - low
