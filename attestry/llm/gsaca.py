"""Suffix sorting by grouping, in linear time and without recursion on a renamed text.

Suffixes are grouped by their Lyndon prefix.  Groups are taken from the highest down: each member finds the
previous position of a lower group by its previous-smaller pointer, and the positions so reached move to a group of
their own, just above their old one, with a prefix that much longer.  When every group has been taken, the groups
are in order, and one pass from the lowest emits each group's members in their final order.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Positions of all suffixes of ``text`` (symbols of 0 or more) in ascending order; a suffix precedes its extensions."""
    n = len(text)
    if n == 0:
        return []
    symbols = sorted(set(text))
    number = {c: i for i, c in enumerate(symbols)}
    group = [number[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    width = [1] * len(symbols)
    above = list(range(1, len(symbols))) + [-1]
    below = list(range(-1, len(symbols) - 1))
    done = bytearray(n)
    previous = [-1] * n
    jump = [-1] * n

    g = len(symbols) - 1
    while g >= 0:
        own = [s for s in members[g] if group[s] == g]
        members[g] = own
        size = width[g]
        reached: dict[int, int] = {}
        for s in own:
            done[s] = 1
        for s in own:
            p = s - 1
            while p >= 0 and done[p]:
                p = jump[p]
            previous[s] = jump[s] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        if reached:
            if len(reached) == 1:
                ((p, c),) = reached.items()
                moves = [((group[p], c), [p])]
            else:
                parts: dict[tuple[int, int], list[int]] = {}
                for p, c in reached.items():
                    parts.setdefault((group[p], c), []).append(p)
                moves = sorted(parts.items(), reverse=True) if len(parts) > 1 else list(parts.items())
            upper: dict[int, int] = {}
            for (old, c), who in moves:  # of one old group the highest count first: it ends highest
                new = len(members)
                who.sort()
                members.append(who)
                width.append(width[old] + c * size)
                top = upper.get(old, above[old])
                above.append(top)
                below.append(old)
                below[top] = new
                above[old] = new
                upper[old] = new
                for p in who:
                    group[p] = new
        g = below[g]

    start = [0] * len(members)
    at, g = 0, _lowest(below)
    while g >= 0:
        start[g] = at
        at += len(members[g])
        g = above[g]
    order = [-1] * n

    def emit(s: int) -> None:
        p = s - 1
        while p >= 0 and p + width[group[p]] == s:
            k = group[p]
            order[start[k]] = p
            start[k] += 1
            p = previous[p]

    emit(n)
    for i in range(n):
        emit(order[i])
    return order


def _lowest(below: list[int]) -> int:
    return next(i for i, b in enumerate(below) if b < 0)
