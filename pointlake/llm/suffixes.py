"""Suffix arrays over word codes, many texts at a time."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray, ends: np.ndarray, depth: int | None = None, keep: int | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array by prefix doubling, and the ranks after each doubling.

    ``codes[i]`` is the symbol at position ``i`` and ``ends[i]`` the end of its text; a suffix stops
    there.  A round sorts only the suffixes whose first ``k`` symbols are not unique yet.  With
    ``depth`` the suffixes are ordered by that many symbols at least; with ``keep`` only ranks by up to that many are returned."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    at = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, at, 0))
    levels = [(1, rank)]
    k = 1
    while depth is None or k < depth:
        last = np.ones(n, bool)
        last[:-1] = first[1:]
        shared = np.flatnonzero(~(first & last))
        if not len(shared):
            break
        pos = order[shared]
        ahead = pos + k
        second = np.where(ahead < ends[pos], rank[np.minimum(ahead, n - 1)], -1 - pos)
        major = rank[pos]
        by = np.lexsort((second, major))
        pos, major, second = pos[by], major[by], second[by]
        order[shared] = pos
        new = np.ones(len(pos), bool)
        new[1:] = (major[1:] != major[:-1]) | (second[1:] != second[:-1])
        first[shared] = new
        rank = rank.copy()
        rank[pos] = np.maximum.accumulate(np.where(new, shared, 0))
        k *= 2
        if keep is None or k <= keep:
            levels.append((k, rank))
    return order, levels


def neighbour_lcp(order: np.ndarray, ends: np.ndarray, levels: list[tuple[int, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``p`` of the suffix array whose suffix shares ``least`` symbols or more with the one at
    ``p + 1``, and the length of their longest common prefix."""
    known = max((x for x in levels if x[0] <= least), key=lambda x: x[0])[1]
    at = np.flatnonzero(known[order[:-1]] == known[order[1:]])
    i, j = order[at], order[at + 1]
    lcp = np.zeros(len(i), np.int64)
    top = len(ends) - 1
    for k, rank in reversed(levels):
        a, b = i + lcp, j + lcp
        inside = (a < ends[i]) & (b < ends[j])
        lcp += np.where(inside & (rank[np.minimum(a, top)] == rank[np.minimum(b, top)]), k, 0)
    deep = lcp >= least
    return at[deep], lcp[deep]


def lengthen(lcp: np.ndarray, left: np.ndarray, right: np.ndarray, codes: np.ndarray, ends: np.ndarray, known: int) -> np.ndarray:
    """Common prefixes of the neighbours ``left`` and ``right`` where ``lcp`` stopped at ``known`` symbols, in linear time.

    Going by the place of ``right``, the prefix of the next place is shorter by one symbol at most, so
    every symbol is compared about once; nothing is kept but the result."""
    deep = np.flatnonzero(lcp >= known)
    deep = deep[np.argsort(right[deep])]
    found = np.zeros(len(deep), np.int64)
    view = memoryview(np.ascontiguousarray(codes, np.int64))
    before, h = -2, 0
    for start in range(0, len(deep), 1 << 16):
        some = deep[start:start + (1 << 16)]
        limit = ends[left[some]] - np.maximum(left[some], right[some])
        for at, (i, j, most) in enumerate(zip(left[some].tolist(), right[some].tolist(), limit.tolist(), strict=True), start):
            h = max(h - 1, known) if j == before + 1 else known
            step = 1
            while h < most and view[i + h] == view[j + h]:
                n = min(step, most - h)
                differ = np.flatnonzero(codes[i + h:i + h + n] != codes[j + h:j + h + n])
                h += int(differ[0]) if len(differ) else n
                step = min(2 * step, 4096)
            found[at], before = h, j
    out = lcp.copy()
    out[deep] = found
    return out


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of ``n`` positions lie in one of the spans at least."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0
