"""Suffix arrays of integer strings by linear grouping: Lyndon-prefix groups in descending order, then their members.

A suffix's group is its longest Lyndon prefix. A suffix begins with its first letter, followed by the groups of its
children, the suffixes whose previous smaller suffix it is. So groups are split while they are visited from the largest
down: a visited group tells each previous smaller suffix how many children it has there, and the suffixes told the same
move behind the rest of their own group. Members of a group are in the order of the suffixes that follow their common
prefix, which the second phase meets in ascending order: no rank is named anew.
"""

from __future__ import annotations

import numpy as np


def groups_and_previous(letters: np.ndarray) -> tuple[list[int], list[int]]:
    """(place where its group begins, previous smaller suffix or -1) of each suffix of a string of integers."""
    n = len(letters)
    by_letter = np.argsort(letters, kind="stable")
    firsts = np.flatnonzero(np.concatenate([[True], np.diff(letters[by_letter]) != 0])) if n else np.empty(0, np.int64)
    sizes = np.diff(np.append(firsts, n))
    begins, places, ends = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n + 1, np.int64)
    begins[by_letter] = np.repeat(firsts, sizes)
    places[by_letter] = np.arange(n)
    ends[firsts] = firsts + sizes
    order, begins, places, ends = by_letter.tolist(), begins.tolist(), places.tolist(), ends.tolist()
    before = list(range(-1, n - 1))
    high = n
    while high:
        low = begins[order[high - 1]]
        told: dict[int, list[int]] = {}
        last, times = -1, 0
        for i in (order[low:high] if high - low == 1 else sorted(order[low:high])):
            p = before[i]
            while p >= 0 and begins[p] >= low:
                p = before[p]
            before[i] = p
            if p == last:
                times += 1
                continue
            if last >= 0:
                told.setdefault(times, []).append(last)
            last, times = p, 1
        if last >= 0:
            told.setdefault(times, []).append(last)
        for times in sorted(told, reverse=True):
            moved = told[times]
            for p in moved:
                end = ends[begins[p]] - 1
                ends[begins[p]] = end
                other, at = order[end], places[p]
                order[end], order[at] = p, other
                places[p], places[other] = end, at
            new = [ends[begins[p]] for p in moved]
            for p, at in zip(moved, new, strict=True):
                begins[p] = at
                ends[at] = max(ends[at], at) + 1
        high = low
    return begins, before


def suffix_array(letters: np.ndarray) -> np.ndarray:
    """The suffixes of a string of integers in ascending order; a suffix that begins another one comes first."""
    n = len(letters)
    free, before = groups_and_previous(letters)
    slots = list(range(n + 1))
    out = [0] * n
    before.append(-1)
    for at in range(-1, n):
        j = out[at] if at >= 0 else n
        stop, i = before[j], j - 1
        while i != stop:
            group = free[i]
            out[slots[group]] = i
            slots[group] += 1
            i = before[i]
    return np.array(out, np.int64)
