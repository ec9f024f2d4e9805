"""Banded alignment of many pairs of sequences at once."""

from __future__ import annotations

import numpy as np


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edit distance of each pair within ``band`` diagonals to either side; what exceeds ``band`` is given as band + 1.

    The table runs over rows; a row holds 2 * band + 1 diagonals of all pairs, diagonals first, so that
    every step works on whole rows of pairs. Symbols are small non-negative integers.
    """
    out = np.full(len(pairs), band + 1, np.int64)
    live = [i for i, (a, b) in enumerate(pairs) if abs(len(a) - len(b)) <= band]
    if not live:
        return out
    live.sort(key=lambda i: -len(pairs[i][0]))
    n = np.array([len(pairs[i][0]) for i in live])
    m = np.array([len(pairs[i][1]) for i in live])
    rows, width, many = int(n[0]), 2 * band + 1, len(live)
    kind = np.int16 if rows + int(m.max()) + 4 * band < 12_000 else np.int32
    far = 14_000 if kind is np.int16 else 1 << 28
    left = np.full((max(rows, 1), many), -2, np.int32)
    # past their ends the right ones go on with a symbol that nothing equals: columns there change nothing before them
    right = np.full((rows + width + 1, many), -1, np.int32)
    for k, i in enumerate(live):
        a, b = pairs[i]
        left[: len(a), k] = a
        right[band : band + len(b), k] = b
    steps = np.arange(width, dtype=kind)[:, None]
    dist = np.where(steps >= band, steps - band, far).astype(kind).repeat(many, axis=1)
    done = np.empty(many, np.int64)
    active = many
    for i in range(rows + 1):
        while active and n[active - 1] == i:
            active -= 1
            done[active] = dist[m[active] - i + band, active]
        if not active:
            break
        d = dist[:, :active]
        new = d + (right[i : i + width, :active] != left[i, :active])
        np.minimum(new[:-1], d[1:] + kind(1), out=new[:-1])
        first = band - i - 1  # diagonal of column 0 in this row
        if first >= 0:
            new[:first] = far
            new[first] = i + 1
        new -= steps
        np.minimum.accumulate(new, axis=0, out=new)
        new += steps
        if first > 0:
            new[:first] = far
        dist = new
    out[live] = np.minimum(done, band + 1)
    return out


def least(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A lower bound of each edit distance.

    An edit changes the count of one symbol by one on a side, and takes away at most two of the longer
    side's pairs of neighbours.
    """
    out = np.empty(len(pairs), np.int64)
    for i, (a, b) in enumerate(pairs):
        size = 1 + max(int(a.max(initial=0)), int(b.max(initial=0)))
        more = np.bincount(a, minlength=size) - np.bincount(b, minlength=size)
        low = max(int(more[more > 0].sum()), -int(more[more < 0].sum()))
        if len(a) > 1 and len(b) > 1:
            two = [x[:-1].astype(np.int64) * size + x[1:] for x in (a, b)]
            _, number = np.unique(np.concatenate(two), return_inverse=True)
            kinds = int(number.max()) + 1
            shared = int(np.minimum(np.bincount(number[: len(two[0])], minlength=kinds), np.bincount(number[len(two[0]) :], minlength=kinds)).sum())
            low = max(low, (max(len(a), len(b)) - 1 - shared + 1) // 2)
        out[i] = low
    return out


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray, cells: int = 1 << 16) -> np.ndarray:
    """Edit distance of each pair where it is at most its limit, else limit + 1.

    What a pair has in common at both ends is cut off first. Pairs whose symbols alone differ too much are
    done; for the others the band starts at what their symbols need, and is doubled, up to the
    limits, for those that do not fit it.
    """
    cut = []
    for a, b in pairs:
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[:k] != b[:k])
        head = int(differ[0]) if len(differ) else k
        a, b = a[head:], b[head:]
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[len(a) - k :][::-1] != b[len(b) - k :][::-1])
        tail = int(differ[0]) if len(differ) else k
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        # small numbers for the symbols of the pair
        _, number = np.unique(np.concatenate([a, b]), return_inverse=True)
        cut.append((number[: len(a)].astype(np.int32), number[len(a) :].astype(np.int32)))
    out = limits + 1
    sizes = np.array([max(len(a), len(b)) for a, b in cut], np.int64)
    low = least(cut)
    open_ = np.flatnonzero(low <= limits)
    band = np.maximum(4, 1 << np.ceil(np.log2(np.maximum(low + 1, 1))).astype(np.int64))
    while len(open_):
        width = int(band[open_].min())
        now = open_[band[open_] == width]
        order = now[np.argsort(sizes[now], kind="stable")]
        k = 0
        while k < len(order):
            some = order[k : k + int(max(1, min(512, cells // (2 * width + 1))))]
            while len(some) > 1 and len(some) * (2 * int(sizes[some[-1]]) + 4 * width) > 4 << 20:
                some = some[: len(some) // 2]
            got = banded([cut[i] for i in some], width)
            out[some] = np.where(got <= np.minimum(width, limits[some]), got, limits[some] + 1)
            k += len(some)
        again = now[(out[now] > limits[now]) & (limits[now] > width)]
        band[again] *= 2
        open_ = np.concatenate([open_[band[open_] > width], again]) if len(again) else open_[band[open_] > width]
        open_ = np.unique(open_)
    return out
