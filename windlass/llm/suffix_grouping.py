"""Suffix arrays by linear grouping.

Suffixes are first grouped by their first symbol. Groups are taken from the
highest down; the suffixes just before a group's members that lie in lower
groups (found over previous-smaller pointers) are moved to a new group right
above their own, those before more copies of the group's prefix higher. When a
group is taken, its common prefix is the Lyndon prefix of its suffixes, so the
groups are in their final order and no suffix is renamed again. The order
inside the groups then follows in one pass over the array: a suffix that has
been placed lets those that end in it, which the same pointers list, take the
next free place of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(symbols: Sequence[int]) -> tuple[list[list[int]], list[int], list[int]]:
    """(groups in ascending order, group of each suffix, previous-smaller pointers)."""
    n = len(symbols)
    of = [0] * n
    members: list[list[int]] = []
    number: dict[int, int] = {}
    for s in sorted(set(symbols)):
        number[s] = len(members)
        members.append([])
    for i, s in enumerate(symbols):
        g = number[s]
        of[i] = g
        members[g].append(i)
    # The next group down, in a list whose head is the highest group.
    below = [g - 1 for g in range(len(members))]
    above = [g + 1 for g in range(len(members))]
    open_ = -2
    pointer = [open_] * n
    final: list[int] = []
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if of[i] == g]
        members[g] = own
        if own:
            final.append(g)
        reached = []
        for i in own:
            p = i - 1
            while p >= 0 and (q := pointer[p]) != open_:
                p = q
            pointer[i] = p
            if p >= 0:
                reached.append(p)
        if reached:
            reached.sort()
            for same in _by_repeats(reached):
                moved: dict[int, int] = {}
                for p in same:
                    old = of[p]
                    new = moved.get(old)
                    if new is None:
                        new = moved[old] = len(members)
                        members.append([])
                        up = above[old]
                        below.append(old)
                        above.append(up)
                        above[old] = new
                        below[up] = new
                    of[p] = new
                    members[new].append(p)
        g = below[g]
    final.reverse()
    return [members[g] for g in final], of, pointer


def _by_repeats(ascending: list[int]) -> list[list[int]]:
    """Distinct values by how often they occur, most often first."""
    distinct = list(dict.fromkeys(ascending))
    if len(distinct) == len(ascending):
        return [distinct]
    times: dict[int, int] = {}
    for p in ascending:
        times[p] = times.get(p, 0) + 1
    by_count: dict[int, list[int]] = {}
    for p in distinct:
        by_count.setdefault(times[p], []).append(p)
    return [by_count[k] for k in sorted(by_count, reverse=True)]


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes in ascending order; a prefix comes first."""
    n = len(symbols)
    groups, of, pointer = lyndon_groups(symbols)
    place: dict[int, int] = {}
    at = 0
    for group in groups:
        place[of[group[0]]] = at
        at += len(group)
    array = [-1] * n
    placed = bytearray(n)
    p = n - 1
    k = 0
    while True:
        while p >= 0 and not placed[p]:
            placed[p] = 1
            g = of[p]
            slot = place[g]
            array[slot] = p
            place[g] = slot + 1
            p = pointer[p]
        if k == n:
            return array
        p = array[k] - 1
        k += 1
