"""Linear suffix sorting by Lyndon grouping, without recursive renaming.

Every suffix begins with its longest Lyndon prefix, which ends where the next smaller suffix begins. Suffixes
with one and the same Lyndon prefix form a group, and groups are ordered as their prefixes are.

First phase: groups start as those of the first symbol. The greatest group that isn't finished is taken; each of its
suffixes points to the nearest position before it whose group isn't finished, which is its previous smaller suffix.
The prefix of that position grows by the group's prefix, as often as members of the group point to it, and
the positions that grow leave their group for new ones right after it, ordered by how often they grew.

Second phase: a suffix is its Lyndon prefix and then the next smaller suffix, so the order within a group is
the order of the next smaller suffixes. Taking suffixes in order, those whose next smaller suffix is the one
taken go to the next free places of their groups; they are found along the previous-smaller pointers.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of all suffixes of ``text`` in ascending order; an end counts as smaller than any symbol."""
    n = len(text)
    if not n:
        return []
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        first.setdefault(c, []).append(i)
    order = sorted(first)
    members = [first[c] for c in order]  # of each group; a member that has left is known by ``group``
    after = list(range(1, len(order))) + [-1]  # the next greater group
    before = list(range(-1, len(order) - 1))
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    length = [1] * n
    smaller = [-1] * n
    finished = bytearray(n)

    size = [len(own) for own in members]
    g = len(order) - 1
    while g >= 0:
        count = size[g]
        if count == 1:  # most groups of most texts: one suffix, so one position grows, once
            own = members[g]
            i = own[0]
            if len(own) > 1:
                for i in own:
                    if group[i] == g:
                        break
            p = i - 1
            while p >= 0 and finished[p]:
                p = smaller[p]
            smaller[i] = p
            finished[i] = 1
            if p >= 0:
                old, new = group[p], len(members)
                length[p] += length[i]
                if size[old] == 1:  # its group moves as a whole and keeps its place
                    g = before[g]
                    continue
                size[old] -= 1
                size.append(1)
                members.append([p])
                nxt = after[old]
                after.append(nxt)
                before.append(old)
                after[old] = new
                if nxt >= 0:
                    before[nxt] = new
                group[p] = new
        elif count:
            own = [i for i in members[g] if group[i] == g]
            grown: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and finished[p]:
                    p = smaller[p]
                if p >= 0 and group[p] == g:  # the same prefix stands right before
                    p = smaller[p]
                smaller[i] = p
                if p >= 0:
                    grown[p] = grown.get(p, 0) + 1
            for i in own:
                finished[i] = 1
            step = length[own[0]]
            if len(grown) == 1:
                ((p, k),) = grown.items()
                moves = [(group[p], k, (p,))]
            else:
                leave: dict[tuple[int, int], list[int]] = {}
                for p, k in grown.items():
                    leave.setdefault((group[p], k), []).append(p)
                moves = [(old, k, leave[old, k]) for old, k in sorted(leave, key=lambda x: -x[1])]
            for old, k, some in moves:  # the most grown first: each goes right after the old group
                new = len(members)
                members.append(sorted(some))
                size.append(len(some))
                size[old] -= len(some)
                nxt = after[old]
                after.append(nxt)
                before.append(old)
                after[old] = new
                if nxt >= 0:
                    before[nxt] = new
                for p in some:
                    group[p] = new
                    length[p] += k * step
        g = before[g]

    place = [0] * len(members)
    at, g = 0, 0
    while g >= 0:
        place[g] = at
        at += size[g]
        g = after[g]
    out = [0] * n
    for k in range(-1, n):
        t = n if k < 0 else out[k]
        s = t - 1
        while s >= 0 and s + length[s] == t:
            g = group[s]
            out[place[g]] = s
            place[g] += 1
            s = smaller[s]
    return out
