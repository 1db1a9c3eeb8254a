"""Suffix arrays by linear grouping, and the repeated windows of a block of passages.

The construction (Baier, 2016) keeps suffixes in groups, ordered by their first symbols.
Groups are taken in descending order. A suffix's pointer leads to the nearest suffix before
it in a lower group; the suffixes pointed at are moved to new groups right above the rest
of theirs, those pointed at more often higher. In the end a group holds the suffixes with
one Lyndon prefix, and going through the order from its start, each suffix places those
that the pointers chain before it at the front of their groups. No symbol is ever renamed.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a symbol.
SYMBOL = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of a sequence of integers, in order."""
    text = np.append(symbols, np.min(symbols, initial=0) - 1)  # the end is below all symbols
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.r_[True, text[order[1:]] != text[order[:-1]]]
    starts = np.flatnonzero(new)
    sizes = np.zeros(n + 1, np.int64)
    sizes[starts] = np.diff(np.r_[starts, n])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    order, place, group, sizes = order.tolist(), place.tolist(), group.tolist(), sizes.tolist()
    smaller = [-1] * n
    end = n
    while end:
        first = group[order[end - 1]]
        pointed: dict[int, int] = {}
        members = order[first:end] if end - first == 1 else sorted(order[first:end])
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = first
        if not pointed:
            continue
        times: dict[int, list[int]] = {}
        for p, k in pointed.items():
            times.setdefault(k, []).append(p)
        for k in sorted(times, reverse=True):
            moved = times[k]
            for p in moved:
                g = group[p]
                sizes[g] -= 1
                last, at = g + sizes[g], place[p]
                other = order[last]
                order[at], place[other] = other, at
                order[last], place[p] = p, last
            above: dict[int, int] = {}
            for p in moved:
                g = group[p]
                if g not in above:
                    above[g] = g + sizes[g]
            fresh: dict[int, int] = {}
            for p in moved:
                group[p] = above[group[p]]
                fresh[group[p]] = fresh.get(group[p], 0) + 1
            for g, size in fresh.items():
                sizes[g] = size
    front = list(range(n))
    placed = bytearray(n)
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = 1
    for at in range(n):
        i = out[at] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[front[g]] = i
            front[g] += 1
            placed[i] = 1
            i = smaller[i]
    return np.array(out[1:], np.int64)


def common_prefixes(rows: np.ndarray, symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, up to ``most``.

    ``rows`` has the bytes of each symbol; zero is the symbol between passages.
    """
    shared = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    padded = np.append(symbols, 0)
    for k in range(-(-most // SYMBOL)):
        a, b = order[live - 1] + k, order[live] + k
        same = (padded[a] == padded[b]) & (padded[a] != 0)
        ended = ~same & (padded[a] != 0) & (padded[b] != 0)
        differ = rows[a[ended]] != rows[b[ended]]
        shared[live[ended]] += differ.argmax(1)
        live = live[same]
        shared[live] += SYMBOL
        if not len(live):
            break
    return shared


def repeated_starts(
    passages: list[bytes], anchors: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, window: int
) -> list[list[tuple[int, int]]]:
    """For each passage the ranges of starts of windows that occur elsewhere as well.

    A passage has ``starts`` windows, one from each of its first bytes. All occurrences of a
    window lie at the same distance from an anchor of equal bytes, at ``anchors`` in each
    passage; symbols are cut in line with it, so equal windows have equal symbols but for
    the ends. A window occurs elsewhere if the least of ``low`` and the largest of ``high`` of
    the passages that hold it differ.
    """
    n = len(passages)
    sizes = np.array([len(p) for p in passages], np.int64)
    left = -anchors % SYMBOL
    count = -(-(left + sizes) // SYMBOL)
    ends = np.cumsum(count + 1)  # a symbol more, between passages
    begin = ends - count - 1
    rows = np.zeros((int(ends[-1]), SYMBOL), np.uint8)
    flat = rows.reshape(-1)
    for i, passage in enumerate(passages):
        at = int(begin[i]) * SYMBOL + int(left[i])
        flat[at : at + len(passage)] = np.frombuffer(passage, np.uint8)
    words = rows.view(">u8").astype(np.uint64)
    owner = np.repeat(np.arange(n), count + 1)
    between = np.zeros(len(rows), bool)
    between[ends - 1] = True
    by_value = np.lexsort((words[:, 1], words[:, 0]))
    changed = (words[by_value[1:]] != words[by_value[:-1]]).any(1)
    symbols = np.empty(len(rows), np.int64)
    symbols[by_value] = np.cumsum(np.r_[1, changed])
    symbols[between] = 0
    order = suffix_array(symbols)
    shared = common_prefixes(rows, symbols, order, window)
    boundary = (np.arange(len(rows)) - begin[owner]) * SYMBOL - left[owner]
    boundary, owner_at = boundary[order], owner[order]
    before = words[order - 1]  # of a passage's first symbol it is not used
    found_owner, found_start = [], []
    for back in range(SYMBOL):
        start = boundary - back
        usable = np.flatnonzero((start >= 0) & (start < starts[owner_at]) & ~between[order])
        if not len(usable):
            continue
        run = np.cumsum(shared < window - back)[usable]
        high_mask = np.uint64((1 << 8 * max(back - 8, 0)) - 1)
        low_mask = np.uint64((1 << 8 * min(back, 8)) - 1)
        ahead, near = before[usable, 0] & high_mask, before[usable, 1] & low_mask
        by_key = np.lexsort((near, ahead, run))
        usable, run, ahead, near = usable[by_key], run[by_key], ahead[by_key], near[by_key]
        new = np.r_[True, (run[1:] != run[:-1]) | (ahead[1:] != ahead[:-1]) | (near[1:] != near[:-1])]
        heads = np.flatnonzero(new)
        owners = owner_at[usable]
        again = np.minimum.reduceat(low[owners], heads) < np.maximum.reduceat(high[owners], heads)
        hit = again[np.cumsum(new) - 1]
        found_owner.append(owners[hit])
        found_start.append(start[usable[hit]])
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if found_owner:
        owners, at = np.concatenate(found_owner), np.concatenate(found_start)
        if not len(at):
            return out
        by_place = np.lexsort((at, owners))
        owners, at = owners[by_place], at[by_place]
        heads = np.flatnonzero(np.r_[True, (owners[1:] != owners[:-1]) | (at[1:] != at[:-1] + 1)])
        tails = np.r_[heads[1:], len(at)] - 1
        for i, a, b in zip(owners[heads].tolist(), at[heads].tolist(), at[tails].tolist()):
            out[i].append((a, b + 1))
    return out
