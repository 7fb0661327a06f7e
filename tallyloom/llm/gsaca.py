"""Suffix sorting by grouping (Baier, 2016): linear time, no recursion, no renaming.

Phase 1 keeps the suffixes in groups of a common Lyndon prefix. Groups are taken in descending order; each
suffix i of the group finds prev(i), the nearest suffix to its left of a smaller group, and the suffixes so
pointed at are split off their groups, those with more pointers further up. Phase 2 walks the array from
its smallest suffix and puts s - 1, prev(s - 1), prev(prev(s - 1)), ... in the next free place of their groups.
"""

from __future__ import annotations


def suffix_array(seq: list[int]) -> list[int]:
    """Suffix array of a list of non-negative numbers; a shorter suffix sorts before those it is a prefix of."""
    n = len(seq) + 1
    if n == 1:
        return []
    # an end mark below every number
    by: dict[int, list[int]] = {}
    for i, c in enumerate(seq):
        by.setdefault(c, []).append(i)
    members = [[n - 1], *(by[c] for c in sorted(by))]
    below = list(range(-1, len(members) - 1))  # the group before, in ascending order
    above = [*range(1, len(members)), -1]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    prev = [-1] * n
    done = bytearray(n)
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        own.sort()
        members[g] = own
        pointed: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[i] = p
            done[i] = 1
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        # the most pointed at leave first: later groups are put right above the old one, below the earlier
        levels: dict[int, dict[int, list[int]]] = {}
        for p, k in pointed.items():
            levels.setdefault(k, {}).setdefault(group[p], []).append(p)
        for k in sorted(levels, reverse=True):
            for old, moved in levels[k].items():
                new = len(members)
                members.append(moved)
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
                for i in moved:
                    group[i] = new
        g = below[g]
    free = [0] * len(members)
    g, at = 0, 0
    while g >= 0:
        free[g] = at
        at += sum(1 for i in members[g] if group[i] == g)
        g = above[g]
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for r in range(n):
        s = out[r] - 1
        while s >= 0 and not placed[s]:
            out[free[group[s]]] = s
            free[group[s]] += 1
            placed[s] = 1
            s = prev[s]
    return out[1:]
