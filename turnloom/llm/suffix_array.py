"""Suffix sorting by grouping, without recursion or renaming.

The steps over the suffixes are linear; symbols and the members of a group are put in order with
the sorts of numpy and Python, which are fast on the few distinct and nearly ordered values here.

Suffixes of one group share their longest Lyndon prefix so far.  Groups are handled in descending
order: each member points to the nearest suffix before it of a smaller group (its previous
smaller), and the suffixes pointed at move to new groups right behind their own, those with more
pointers further back.  Once all groups are handled, a scan of the emerging array emits each
group's order: a placed suffix places its predecessor and that one's chain of pointers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int] | np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` (non-negative integers) in ascending order."""
    symbols = np.asarray(text, dtype=np.int64)
    n = len(symbols) + 1
    if n == 1:
        return np.zeros(0, dtype=np.int64)
    symbols = np.append(symbols + 1, 0)  # the end is smaller than any symbol
    order = np.argsort(symbols, kind="stable")
    is_new = np.concatenate(([True], np.diff(symbols[order]) != 0))
    begins = np.flatnonzero(is_new)
    link_ = np.empty(n, dtype=np.int64)
    link_[order] = begins[np.cumsum(is_new) - 1]
    end_ = np.zeros(n + 1, dtype=np.int64)
    end_[begins] = np.append(begins[1:], n)
    at_ = np.empty(n, dtype=np.int64)
    at_[order] = np.arange(n)
    arranged, link, end, at = order.tolist(), link_.tolist(), end_.tolist(), at_.tolist()
    before = [-1] * n

    done = n
    while done > 0:
        begin = link[arranged[done - 1]]
        if done - begin == 1:
            i = arranged[begin]
            j = i - 1
            while j >= 0 and link[j] >= begin:
                j = before[j]
            before[i] = j
            if j >= 0:
                g = link[j]
                last = end[g] - 1
                if last > g:
                    other, place = arranged[last], at[j]
                    arranged[place], at[other] = other, place
                    arranged[last], at[j] = j, last
                    end[g], link[j], end[last] = last, last, last + 1
            done = begin
            continue
        pointers: dict[int, int] = {}
        for i in sorted(arranged[begin:done]):
            j = i - 1
            while j >= 0 and link[j] >= begin:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        done = begin
        if not pointers:
            continue
        levels: dict[int, list[int]] = {}
        for j, count in pointers.items():
            levels.setdefault(count, []).append(j)
        for count in sorted(levels, reverse=True):
            moved = levels[count]
            for j in moved:
                g = link[j]
                last = end[g] - 1
                other, place = arranged[last], at[j]
                arranged[place], at[other] = other, place
                arranged[last], at[j] = j, last
                end[g] = last
            sizes: dict[int, int] = {}
            for j in moved:
                sizes[link[j]] = sizes.get(link[j], 0) + 1
            fresh = {g: end[g] for g in sizes}
            for j in moved:
                link[j] = fresh[link[j]]
            for g, size in sizes.items():
                end[fresh[g]] = fresh[g] + size

    result = [0] * n
    free = list(range(n))
    placed = bytearray(n)
    result[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = result[i] - 1
        while j >= 0 and not placed[j]:
            g = link[j]
            result[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return np.array(result[1:], dtype=np.int64)
