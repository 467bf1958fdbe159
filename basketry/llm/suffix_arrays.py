"""Suffix arrays in numpy, as far as ``depth`` units tell.

A buffer is of bytes (uint8) or of wider units, such as one 64-bit hash a word.
"""

from __future__ import annotations

import numpy as np

FIRST = 7  # bytes of the first key


def packed(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each position as one big-endian number; zeros past the end."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for j in range(width):
        out <<= np.uint64(8)
        out |= padded[j:j + len(data)]
    return out


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first ``depth`` units or more (Larsson-Sadakane refinement).

    Each round doubles the units by which groups are told apart and sorts only
    the members of groups that still have more than one.  Positions and ranks
    take 4 bytes each where they fit, so a round holds about 60 bytes a unit.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    if data.dtype == np.uint8:
        key, h = packed(data, FIRST).view(np.int64), FIRST
    else:
        key, h = np.unique(data, return_inverse=True)[1].astype(np.int64), 1
    kind = np.int32 if n < 1 << 30 else np.int64
    sa = np.argsort(key, kind="stable").astype(kind)
    key = key[sa]
    head = np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(n, dtype=kind), kind(0))
    del key
    np.maximum.accumulate(head, out=head)
    rank = np.full(n + 1, -1, kind)  # a suffix past the end is least
    rank[sa] = head
    while h < depth:
        single = np.concatenate([head[1:] != head[:-1], [True]]) & np.concatenate([[True], head[1:] != head[:-1]])
        at = np.nonzero(~single)[0]
        if not len(at):
            break
        members = sa[at]
        both = rank[members].astype(np.int64)
        both *= n + 2
        both += rank[np.minimum(members + kind(min(h, n)), n)]
        order = np.argsort(both, kind="stable")
        members, both = members[order], both[order]
        sa[at] = members
        start = np.concatenate([[True], both[1:] != both[:-1]])
        del both, order
        head[at] = np.maximum.accumulate(np.where(start, at, 0))
        rank[members] = head[at]
        h *= 2
    return sa


def comparable(data: np.ndarray, length: int) -> tuple[np.ndarray, bool]:
    """What ``common`` compares, padded past every position asked for: 8 bytes from each position, or single wider units."""
    padded = np.concatenate([data, np.zeros(2 * length, data.dtype)])
    return (packed(padded, 8), True) if data.dtype == np.uint8 else (padded, False)


def common(compared: tuple[np.ndarray, bool], a: np.ndarray, b: np.ndarray, cap: int, known: np.ndarray | None = None) -> np.ndarray:
    """Equal units from positions a and b, counted on from ``known``, up to ``cap`` (of bytes up to 7 more)."""
    words, of_bytes = compared
    h = np.zeros(len(a), np.int64) if known is None else known.copy()
    live = np.nonzero(h < cap)[0]
    while len(live) and not of_bytes:
        live = live[words[a[live] + h[live]] == words[b[live] + h[live]]]
        h[live] += 1
        live = live[h[live] < cap]
    while len(live):
        x = words[a[live] + h[live]] ^ words[b[live] + h[live]]
        differing = np.zeros(len(live), np.int64)
        for k in range(8):
            differing += x >= np.uint64(1 << (8 * k))
        h[live] += 8 - differing
        live = live[(differing == 0) & (h[live] < cap)]
    return h


def repeated_starts(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which of the positions starts[w] .. starts[w] + counts[w] - 1 begin a string of ``length`` units that begins at another of them.

    Suffix array, then Kasai's common prefixes over the valid positions in
    suffix order, all windows in lockstep: moving on by one unit keeps all but
    one of the common prefix with the predecessor.
    """
    n = len(data)
    valid = np.zeros(n, bool)
    for s, c in zip(starts.tolist(), counts.tolist()):
        valid[s:s + c] = True
    sa = suffix_array(data, n)  # to the end: prefixes carry over only in the full order
    order = sa[valid[sa]]
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = comparable(data, length)
    out, h = np.zeros(n, bool), np.zeros(len(starts), np.int64)
    last = np.full(len(starts), -1, np.int64)
    for t in range(int(counts.max(initial=0))):
        lane = np.nonzero(counts > t)[0]
        i = starts[lane] + t
        j = before[i]
        # the earlier prefix carries over only if its partner's next position is valid too
        carried = (last[lane] >= 0) & valid[np.minimum(last[lane] + 1, n - 1)]
        h[lane] = np.where(carried, np.maximum(h[lane] - 1, 0), 0)
        last[lane] = j
        has = j >= 0
        lane, i, j = lane[has], i[has], j[has]
        h[lane] = common(words, i, j, length, h[lane])
        hit = h[lane] >= length
        out[i[hit]] = True
        out[j[hit]] = True
    return out


def found_in(data: np.ndarray, own: np.ndarray, other: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``own`` and ``other`` (each in suffix order) whose ``length`` units the two share.

    Merges two sorted shards by binary search of each position of one in the other.
    """
    words = comparable(data, length)

    def hits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), len(b), np.int64)
        while (low < high).any():
            live = np.nonzero(low < high)[0]
            mid = (low[live] + high[live]) // 2
            h = np.minimum(common(words, a[live], b[mid], length), length)
            end = np.minimum(h, length - 1)
            less = (h < length) & (data[b[mid] + end] < data[a[live] + end])
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
        inside = np.nonzero(low < len(b))[0]
        same = common(words, a[inside], b[low[inside]], length) >= length
        return a[inside[same]]

    if not len(own) or not len(other):
        return own[:0], other[:0]
    return hits(own, other), hits(other, own)
