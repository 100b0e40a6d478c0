"""Suffix arrays by grouping of Lyndon prefixes, in linear time and without recursion or renaming.

First, suffixes that share a first symbol form a group. Groups are processed in descending order. For each
suffix of a group, its previous smaller pointer leads to the nearest suffix before it that lies in a lower
group; that suffix's own prefix goes on with this group's, so it moves to a new group right above its old
one, the higher the more often it is pointed at. When all groups have been processed, suffixes lie together
exactly if their longest Lyndon prefixes are equal. Then the order inside the groups is emitted in one
ascending sweep: a suffix that has got its place places the suffixes before it that it bounds.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np


def lyndon_groups(text: list[int]) -> tuple[list[list[int]], list[int]]:
    """(groups in ascending order, previous smaller pointers); the end of the text is below every symbol."""
    n = len(text)
    group_of = [0] * n
    members: list[set[int] | list[int]] = []
    by_symbol: dict[int, set[int]] = defaultdict(set)
    for i, c in enumerate(text):
        by_symbol[c].add(i)
    below: list[int] = []
    above: list[int] = []
    for k, c in enumerate(sorted(by_symbol)):
        own = by_symbol[c]
        members.append(own)
        for i in own:
            group_of[i] = k
        below.append(k - 1)
        above.append(k + 1)
    if not members:
        return [], []
    above[-1] = -1
    done = bytearray(n)
    prev = [-1] * n
    top = len(members) - 1
    order: list[int] = []
    g = top
    while g >= 0:
        own = sorted(members[g])
        members[g] = own
        order.append(g)
        for i in own:
            done[i] = 1
        # previous smaller pointers: skip what has been processed, this group included
        count: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        if count:
            if len(count) == 1 or max(count.values()) == 1:
                levels = [list(count)]
            else:
                at: dict[int, list[int]] = defaultdict(list)
                for j, k in count.items():
                    at[k].append(j)
                levels = [at[k] for k in sorted(at, reverse=True)]
            for level in levels:  # most pointed at first: each new group goes right above the old one
                made: dict[int, int] = {}
                for j in level:
                    old = group_of[j]
                    if old not in made and len(members[old]) == 1:
                        continue  # alone in its group: it is its own new group
                    new = made.get(old)
                    if new is None:
                        new = len(members)
                        made[old] = new
                        members.append(set())
                        up = above[old]
                        above.append(up)
                        below.append(old)
                        above[old] = new
                        if up >= 0:
                            below[up] = new
                    members[old].discard(j)
                    members[new].add(j)
                    group_of[j] = new
                for old, new in made.items():
                    if not members[old]:  # all have moved
                        lo = below[old]
                        below[new] = lo
                        if lo >= 0:
                            above[lo] = new
        g = below[g]
    order.reverse()
    return [members[k] for k in order], prev


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence of small non-negative integers."""
    symbols = text.tolist()
    groups, prev = lyndon_groups(symbols)
    n = len(symbols)
    front = [0] * n
    place = [0] * n
    at = 0
    for k, own in enumerate(groups):
        front[k] = at
        at += len(own)
        for i in own:
            place[i] = k
    out = [-1] * n
    placed = bytearray(n)

    def bound(i: int) -> None:
        """Place the suffixes before i that end their Lyndon prefix at i."""
        j = i - 1
        while j >= 0 and not placed[j]:
            k = place[j]
            out[front[k]] = j
            front[k] += 1
            placed[j] = 1
            j = prev[j]

    bound(n)  # the empty suffix is the smallest
    for r in range(n):
        bound(out[r])
    return np.array(out, dtype=np.int64)
