"""Suffix sorting by a difference cover modulo 3, in numpy."""

from __future__ import annotations

import numpy as np


def _joined(columns: list[np.ndarray], bounds: list[int]) -> np.ndarray:
    """One integer for each row that keeps the rows' order; a column's values are below its bound."""
    key, bound = columns[0], bounds[0]
    for column, most in zip(columns[1:], bounds[1:], strict=True):
        if bound * most >= 1 << 63:
            held, key = np.unique(key, return_inverse=True)
            bound = len(held)
        key, bound = key * most + column, bound * most
    return key


def _names(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and each one's rank from 1 (equal keys share it)."""
    order = np.argsort(key)
    held = key[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.append(True, held[1:] != held[:-1]))
    return order, rank


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The starts of the sorted suffixes of ``s`` (values from 1).

    Triples at positions not divisible by three are sorted and named; where names repeat, the
    string of names is sorted by recursion; the other suffixes follow from their first value and
    the rank behind it, and are merged in by counting the sampled suffixes before each.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    # one more position where n leaves a remainder of 1, so that the mod-1 names end with a mark
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    bound = int(t.max()) + 1
    order, name = _names(_joined([t[sample], t[sample + 1], t[sample + 2]], [bound] * 3))
    if name[order[-1]] < len(sample):
        order = suffix_array(name)
        name = np.empty(len(sample), np.int64)
        name[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name
    sampled = sample[order]
    zero = np.arange(0, n, 3)
    wide = len(sample) + 2
    pair = lambda i: _joined([t[i], rank[i + 1]], [bound, wide])
    zero = zero[np.argsort(pair(zero))]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    # keys are made together, as they may be ranks
    key = pair(np.concatenate([ones, zero]))
    less = np.searchsorted(key[: len(ones)], key[len(ones) :])
    both = np.concatenate([twos, zero])
    key = _joined([t[both], t[both + 1], rank[both + 2]], [bound, bound, wide])
    less = less + np.searchsorted(key[: len(twos)], key[len(twos) :])
    out = np.empty(len(sampled) + len(zero), np.int64)
    place = less + np.arange(len(zero))
    free = np.ones(len(out), bool)
    free[place] = False
    out[place] = zero
    out[free] = sampled
    return out[out < n]
