"""Suffix array by linear grouping.

Suffixes that start with the same Lyndon word form a group. Phase one starts with a group per first symbol and takes the groups in
descending order: a suffix's previous smaller suffix, found by following pointers past suffixes already in the same or a higher
group, has the suffix's Lyndon word as a continuation of its own, so it leaves its group for a new one right above; more copies of
the word in a row give a higher group. Phase two walks the array upwards: a suffix's place in its group is given by the next
smaller suffix behind its Lyndon word, which stands before it. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of all suffixes in ascending order; symbols are positive. Linear time."""
    text = [*symbols, 0]
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    head = [0] * n
    size = [0] * (n + 1)
    last, start = -1, 0
    for at, i in enumerate(order):
        if text[i] != last:
            last, start = text[i], at
        place[i] = at
        head[i] = start
        size[start] += 1
    before = [-1] * n

    def lift(p: int) -> None:
        """Move one suffix to the top of its group, as a group of its own for now."""
        h = head[p]
        size[h] -= 1
        top = h + size[h]
        at, other = place[p], order[top]
        order[at], place[other] = other, at
        order[top], place[p] = p, top

    end = n - 1
    while end >= 0:
        g = head[order[end]]
        if g == end:
            i = order[end]
            p = i - 1
            while p >= 0 and head[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0 and size[head[p]] > 1:
                lift(p)
                head[p] = place[p]
                size[place[p]] = 1
        else:
            members = sorted(order[g : end + 1])
            times: dict[int, int] = {}
            for i in members:
                p = i - 1
                while p >= 0 and head[p] >= g:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            if times:
                by_times: dict[int, list[int]] = {}
                for p, k in times.items():
                    by_times.setdefault(k, []).append(p)
                for k in sorted(by_times, reverse=True):
                    group = by_times[k]
                    for p in group:
                        lift(p)
                    tops = [head[p] + size[head[p]] for p in group]
                    for p, top in zip(group, tops):
                        head[p] = top
                        size[top] += 1
        end = g - 1
    free = list(range(n))  # next free place of the group that starts there
    out = [-1] * n
    open_ = [True] * n
    out[0] = n - 1
    open_[n - 1] = False
    for at in range(n):
        i = out[at] - 1
        while i >= 0 and open_[i]:
            h = head[i]
            out[free[h]] = i
            free[h] += 1
            open_[i] = False
            i = before[i]
    return out[1:]
