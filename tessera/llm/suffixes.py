"""Suffix arrays in linear steps, by groups of suffixes that share their longest Lyndon prefix."""

from __future__ import annotations

from collections import Counter


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of text, in order. Symbols are integers from 1 on.

    First the groups are found. To begin with, a group holds the suffixes of one symbol. Groups are taken from the highest down; the
    Lyndon prefix of a suffix in the group taken ends there, and it goes on the end of that of the nearest suffix before it in a
    lower group. Such suffixes leave their group for new ones right behind it, the more prefixes they have taken up the higher.

    Members of a group may come in any order: one whose pointer depends on another's waits for it. Symbols and levels are bucketed, so no
    step compares suffixes.

    Then each group is put in order without another look at the text: suffixes are read in ascending order, and each gives the next
    free place of their groups to those before it that have no smaller suffix nearer. Both passes walk by the same pointers to the
    previous smaller group.
    """
    n = len(text) + 1
    text = [*text, 0]
    symbols: list[list[int]] = [[] for _ in range(max(text) + 1)]
    for i, c in enumerate(text):
        symbols[c].append(i)
    order: list[int] = []
    rank, group, size = [0] * n, [0] * n, [0] * n
    for starts in symbols:
        first = len(order)
        for at, i in enumerate(starts, first):
            rank[i], group[i] = at, first
        order += starts
        if starts:
            size[first] = len(starts)
    unset = -2
    smaller = [unset] * n
    end = n
    while end > 0:
        g = group[order[end - 1]]
        members = order[g:end]
        end = g
        taken: dict[int, int] = {}
        for member in members:
            waiting = [member] if smaller[member] == unset else []
            while waiting:
                i = waiting[-1]
                p = i - 1
                while p >= 0 and group[p] >= g and smaller[p] != unset:
                    p = smaller[p]
                if p >= 0 and group[p] == g:  # a member further left that waits for its own pointer
                    waiting.append(p)
                    continue
                waiting.pop()
                smaller[i] = p
                if p >= 0:
                    taken[p] = taken.get(p, 0) + 1
        if not taken:
            continue
        if len(taken) == 1:
            levels = [list(taken)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, c in taken.items():
                by_count.setdefault(c, []).append(p)
            levels = [by_count[c] for c in sorted(by_count, reverse=True)]
        for level in levels:
            moved: dict[int, int] = {}
            for p in level:
                old = group[p]
                size[old] -= 1
                to, at = old + size[old], rank[p]
                other = order[to]
                order[at], order[to] = other, p
                rank[other], rank[p] = at, to
                moved[old] = moved.get(old, 0) + 1
            new = {old: old + size[old] for old in moved}
            for p in level:
                group[p] = new[group[p]]
            for old, count in moved.items():
                size[new[old]] = count
    free, placed = list(range(n)), [False] * n
    order[0], placed[n - 1] = n - 1, True
    for at in range(n):
        i = order[at] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            order[free[g]] = i
            free[g] += 1
            placed[i] = True
            i = smaller[i]
    return order[1:]


def lyndon_groups(text: list[int]) -> Counter:
    """How many suffixes share each longest Lyndon prefix, by trying all prefixes; for tests."""

    def is_lyndon(w: tuple[int, ...]) -> bool:
        return all(w < w[i:] for i in range(1, len(w)))

    return Counter(max((tuple(text[i:j]) for j in range(i + 1, len(text) + 1) if is_lyndon(tuple(text[i:j]))), key=len) for i in range(len(text)))
