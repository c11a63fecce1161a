"""Suffix arrays by induced sorting (SA-IS), and permuted common prefixes, in whole-array steps.

Suffixes are classified as smaller or larger than their right neighbour; the substrings between leftmost smaller
ones are sorted by induction, named, and sorted recursively; from their order that of the larger suffixes is induced,
and from theirs that of all smaller ones.  Scans entry by entry would be slow here, and scans by runs of buckets take
tens of thousands of small steps where symbols are many.  So a kind is induced all at once: its suffixes are sorted by
their symbol and the slot of the right neighbour, and those that tie by slots farther on, in rounds that double.
"""

from __future__ import annotations

import numpy as np


def _smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its right neighbour; the last one is."""
    n = len(t)
    at = np.where(np.append(t[:-1] != t[1:], True), np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    inner = at < n - 1
    out[inner] = t[at[inner]] < t[at[inner] + 1]
    return out


def _by_pair(a: np.ndarray, b: np.ndarray, top_a: int, top_b: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by (a, b), values below these tops, and where in it another pair begins."""
    bits_b, bits = int(top_b).bit_length(), len(a).bit_length()
    used = int(top_a).bit_length() + bits_b
    if used > 63:
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        return order, np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    key = a.astype(np.int64) << bits_b
    key |= b
    if used + bits <= 63:  # numbers that hold their own index are sorted faster than an index by numbers
        key <<= bits
        key |= np.arange(len(a))
        key.sort()
        order = key & ((1 << bits) - 1)
        key >>= bits
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    return order, np.concatenate([[True], key[1:] != key[:-1]])


def _sizes(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def _induce_kind(t: np.ndarray, at: np.ndarray, slot: np.ndarray, steps: np.ndarray, low: np.ndarray) -> None:
    """Slots of all suffixes of one kind (at) from those of the other kind, which end their runs.

    ``low``: each bucket's first slot for this kind.  Suffixes that tie share the first slot of their group.  Once
    ``known`` symbols decide the order, those that still tie are told apart by the slots that far on, and twice as
    many decide it: so runs of any length take few rounds.
    """
    if not len(at):
        return
    here = t[at]
    order, new = _by_pair(here, slot[at + 1], len(low), len(slot))
    at, here = at[order], here[order]
    del order
    bucket = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
    group = np.flatnonzero(new)
    size = _sizes(group, len(at))
    slot[at] = np.repeat(group.astype(slot.dtype), size) + np.repeat((low[here[bucket]] - bucket).astype(slot.dtype), _sizes(bucket, len(at)))
    known = 2
    at = at[np.repeat(size > 1, size)]
    at = at[steps[at] >= known]
    while len(at):
        mine = slot[at]
        order, new = _by_pair(mine, slot[at + known], len(slot), len(slot))
        at, mine = at[order], mine[order]
        before = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        group = np.flatnonzero(new)
        size = _sizes(group, len(at))
        slot[at] = mine + np.repeat(group, size) - np.repeat(before, _sizes(before, len(at)))
        known *= 2
        at = at[np.repeat(size > 1, size)]
        at = at[steps[at] >= known]


def _induce(t: np.ndarray, smaller: np.ndarray, start: np.ndarray, lms: np.ndarray, lms_slot: np.ndarray) -> np.ndarray:
    """The slot of each suffix that these slots of the leftmost smaller ones induce; where those tie, others may."""
    n = len(t)
    kind = np.int64 if n >= 1 << 31 else np.int32
    slot = np.zeros(n, kind)
    edge = np.append(np.flatnonzero(smaller[1:] != smaller[:-1]) + 1, n)
    steps = np.repeat(edge.astype(kind), np.diff(edge, prepend=0))
    steps -= np.arange(n, dtype=kind)  # to the next suffix of the other kind
    at = np.flatnonzero(~smaller).astype(kind)
    middle = start + np.bincount(t[at], minlength=len(start))  # the larger ones of a bucket come first
    slot[at] = start[t[at]]
    slot[lms] = lms_slot
    _induce_kind(t, at, slot, steps, start)
    at = np.flatnonzero(smaller[:-1]).astype(kind)
    slot[at] = middle[t[at]]
    slot[-1] = 0
    _induce_kind(t, at, slot, steps, middle)
    return slot


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of symbols below ``k``; the last symbol must be 0 and occur only there."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    t = t.astype(np.int32, copy=False)
    count = np.bincount(t, minlength=k).astype(np.int64)
    end = np.cumsum(count)
    start = end - count
    smaller = _smaller(t)
    is_lms = smaller.copy()
    is_lms[0] = False
    is_lms[1:] &= ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    per = np.bincount(t[lms], minlength=k)
    first = end - per
    slot = _induce(t, smaller, start, lms, first[t[lms]])[lms]
    used = np.zeros(n, bool)  # substrings that are equal share a slot
    used[slot] = True
    name = (np.cumsum(used, dtype=slot.dtype) - 1)[slot]
    found = int(name.max()) + 1
    if found < len(lms):
        ordered = lms[suffix_array(name, found)]
    else:
        ordered = np.empty_like(lms)
        ordered[name] = lms
    slot = _induce(t, smaller, start, ordered, np.arange(len(ordered)) + (first - np.cumsum(per) + per)[t[ordered]])
    sa = np.empty(n, slot.dtype)
    sa[slot] = np.arange(n, dtype=slot.dtype)
    return sa


def permuted_lcp(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cap: int) -> np.ndarray:
    """For each position of the segments (``lengths`` positions from each of ``starts``), the common prefix with the
    suffix before it in the array, at most ``cap``; elsewhere 0.

    From one position to the next the prefix shrinks by one at most; all segments walk in step.
    """
    before = np.zeros(len(t), sa.dtype)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(len(t), np.int32)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    h = np.zeros(len(starts), np.int64)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -step, "left"))
        at = starts[:n] + step
        other = before[at].astype(np.int64)
        h = np.maximum(h[:n] - 1, 0)
        go = np.arange(n)
        while len(go):
            go = go[h[go] < cap]
            go = go[t[at[go] + h[go]] == t[other[go] + h[go]]]
            h[go] += 1
        out[at] = h
    return out
