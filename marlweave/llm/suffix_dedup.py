"""Removal of byte strings that repeat, by a hash-compared suffix sort."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .common import prefix_hash, ranges, span_hash, symbol_table
from .repeats import BYTES, Groups, remove_repeats


def common_length(equal: Callable, limit: np.ndarray) -> np.ndarray:
    """The longest common extension of each pair, by binary search on equality of hashes."""
    low, high = np.zeros_like(limit), limit.copy()
    for _ in range(int(limit.max(initial=0)).bit_length()):
        middle = (low + high + 1) >> 1
        same = equal(middle)
        low = np.where(same, middle, low)
        high = np.where(same, high, np.maximum(middle - 1, low))
    return low


class Side:
    """Suffixes, or prefixes read backwards, of places in a buffer, compared by hashes."""

    def __init__(self, prefix: np.ndarray, data: np.ndarray, place: np.ndarray, length: np.ndarray, backward: bool) -> None:
        self.prefix, self.data, self.place, self.length, self.backward = prefix, data, place, length, backward
        self.head: np.ndarray | None = None

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.place[a], self.place[b]
        if self.backward:
            return common_length(lambda n: span_hash(self.prefix, x - n, n) == span_hash(self.prefix, y - n, n), np.minimum(self.length[a], self.length[b]))
        return common_length(lambda n: span_hash(self.prefix, x, n) == span_hash(self.prefix, y, n), np.minimum(self.length[a], self.length[b]))

    def unit(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The byte after n common ones; -1 at the end."""
        at = self.place[a] - n - 1 if self.backward else self.place[a] + n
        inside = n < self.length[a]
        return np.where(inside, self.data[np.where(inside, at, 0)].astype(np.int64), -1)

    def heads(self) -> np.ndarray:
        """The first seven bytes of each and how many there are, as a number that sorts like them."""
        out = np.zeros(len(self.place), np.int64)
        for k in range(7):
            inside = k < self.length
            at = self.place - k - 1 if self.backward else self.place + k
            out = (out << 8) | np.where(inside, self.data[np.where(inside, at, 0)].astype(np.int64), 0)
        return (out << 3) | np.minimum(self.length, 7)

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.head is None:
            self.head = self.heads()
        out = self.head[a] - self.head[b]
        alike = np.flatnonzero(out == 0)
        if len(alike):
            a, b = a[alike], b[alike]
            n = self.common(a, b)
            out[alike] = self.unit(a, n) - self.unit(b, n)
        return out


def merge_sort(side: Side, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes inside each group (given in order), by mergesort.

    All merges of one level are made together: each suffix finds its rank in the other
    half by binary search, a comparison costing a logarithmic number of hashes.
    """
    n = len(group)
    order = np.arange(n)
    first = np.searchsorted(group, group, side="left")
    size = np.searchsorted(group, group, side="right") - first
    width, widest = 1, int(size.max(initial=0))
    while width < widest:
        place = np.arange(n) - first
        run = place // width
        low = (run ^ 1) * width
        at = np.flatnonzero(low < size)
        begin = first[at] + low[at]
        lo, hi = begin.copy(), first[at] + np.minimum(low[at] + width, size[at])
        mine, after = order[at], (run[at] & 1) == 1
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            c = side.compare(mine[open_], order[middle])
            before = np.where(after[open_], c >= 0, c > 0)
            lo[open_] = np.where(before, middle + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], middle)
            open_ = open_[lo[open_] < hi[open_]]
        new = order.copy()
        new[first[at] + (run[at] & ~1) * width + place[at] % width + (lo - begin)] = mine
        order = new
        width *= 2
    return order


def neighbours(side: Side, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common length of each suffix with the next in order; -1 where the group ends. One more at each end."""
    out = np.full(len(order) + 1, -1, np.int64)
    pairs = np.flatnonzero(group[1:] == group[:-1])
    if len(pairs):
        out[pairs + 1] = side.common(order[pairs], order[pairs + 1])
    return out


def smaller(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the nearest place before, and after it, that holds a smaller one."""
    n = len(x)
    before, past = [-1] * n, [n] * n
    stack: list[int] = []
    values = x.tolist()
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            past[stack.pop()] = i
        before[i] = stack[-1] if stack and values[stack[-1]] < v else (before[stack[-1]] if stack else -1)
        stack.append(i)
    return np.array(before, np.int64), np.array(past, np.int64)


def classes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A member of each class of equal keys, in order of the keys, and the class of every row."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1])
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(new) - 1
    return order[new], out


def depths(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distinct lengths that the i-th in order has in common with any other of its group."""
    before, past = smaller(adjacent)
    n = len(adjacent) - 1
    who = np.arange(n)
    lo, hi = who.copy(), who + 1
    out_who, out_depth = [], []
    while len(who):
        a, b = adjacent[lo], adjacent[hi]
        depth = np.maximum(a, b)
        live = depth >= 0
        who, lo, hi, a, b, depth = who[live], lo[live], hi[live], a[live], b[live], depth[live]
        out_who.append(who)
        out_depth.append(depth)
        lo, hi = np.where(a == depth, before[lo], lo), np.where(b == depth, past[hi], hi)
    return (np.concatenate(out_who), np.concatenate(out_depth)) if out_who else (who, who)


def resolver(width: int, gram: int):
    """Maximal repeats of at least ``width`` bytes among the contexts of a group.

    Contexts that share neither of two halves around the anchor have no repeat. The others
    are sorted by what precedes the anchor, read backwards; the lengths that a
    context has in common with any other there are the values on its way up the tree of common
    lengths. Each such length is a place where a repeat can start, and all maximal repeats start
    at one. The suffixes from these places are sorted; a suffix's longest common extension
    with another is the one with a neighbour, and if it reaches ``width`` it is a repeat. Neighbours
    that the hashes call equal are compared byte by byte; on a collision all is done
    again with other hashes. A context that occurs more than once stands in the sort once, with its
    number: its suffixes' longest extension is that with their copies, up to the end.
    """

    def once(x: Groups, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        prefix = prefix_hash(symbol_table(seed)[x.data])
        size = np.diff(x.at)
        anchor = x.at[:-1] + x.left
        right = size - x.left
        # a window has half of what it holds besides the anchor on one of its sides
        side = (width - gram) // 2
        lived = np.zeros(len(size), bool)
        for begin, length in ((anchor - side, side + gram), (anchor, width - side - 1)):
            able = np.flatnonzero((begin >= x.at[:-1]) & (begin + length <= x.at[1:]))
            _, kind = classes(x.group[able], span_hash(prefix, begin[able], np.full(len(able), length)))
            lived[able[np.bincount(kind, x.copies[able], 1)[kind] > 1]] = True
        live = np.flatnonzero(lived)
        if not len(live):
            return live, live, live
        # contexts with the same before the anchor are sorted once
        one, kind = classes(x.group[live], x.left[live], span_hash(prefix, anchor[live] - x.left[live], x.left[live]))
        first = live[one]
        backward = Side(prefix, x.data, anchor[first], x.left[first], True)
        order = merge_sort(backward, x.group[first])
        at, depth = depths(neighbours(backward, order, x.group[first]))
        at = order[at]
        many = np.bincount(kind, minlength=len(first))
        twins = np.flatnonzero(np.bincount(kind, x.copies[live], len(first)) > 1)
        at, depth = np.concatenate([at, twins]), np.concatenate([depth, x.left[first[twins]]])
        # twins may have all before the anchor in common with another too; listed twice, a suffix would be its own copy
        pair, _ = classes(at, depth)
        at, depth = at[pair], depth[pair]
        # every place where a repeat can start, for every context
        members = np.argsort(kind, kind="stable")
        start_of = np.cumsum(many) - many
        who = live[members[ranges(start_of[at], many[at])]]
        depth = np.repeat(depth, many[at])
        start, length = anchor[who] - depth, right[who] + depth
        keep = length >= width
        who, depth, start, length = who[keep], depth[keep], start[keep], length[keep]
        _, family = classes(x.group[who], depth, span_hash(prefix, start, np.full(len(start), width)))
        shared = np.bincount(family, x.copies[who], 1)[family] > 1
        who, depth, start, length, family = who[shared], depth[shared], start[shared], length[shared], family[shared]
        if not len(who):
            return who, depth, depth
        # suffixes that are the same up to the end of their contexts are sorted once
        one, same = classes(family, length, span_hash(prefix, start, length))
        forward = Side(prefix, x.data, start[one], length[one], False)
        order = merge_sort(forward, family[one])
        near = neighbours(forward, order, family[one])
        longest = np.zeros(len(one), np.int64)
        longest[order] = np.maximum(near[:-1], near[1:])
        twice = np.bincount(same, x.copies[who], len(one)) > 1
        longest[twice] = length[one][twice]
        pairs = np.flatnonzero(near[1:-1] >= width)
        a, b, n = start[one][order[pairs]], start[one][order[pairs + 1]], near[pairs + 1]
        others = np.flatnonzero(np.arange(len(who)) != one[same])
        a, b, n = np.concatenate([a, start[one[same[others]]]]), np.concatenate([b, start[others]]), np.concatenate([n, length[others]])
        for k in range(0, len(a), 4096):
            if not np.array_equal(x.data[ranges(a[k : k + 4096], n[k : k + 4096])], x.data[ranges(b[k : k + 4096], n[k : k + 4096])]):
                return None
        longest = longest[same]
        repeat = longest >= width
        return who[repeat], -depth[repeat], longest[repeat] - depth[repeat]

    def run(x: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seed = 101
        while (out := once(x, seed)) is None:
            seed += 1
        return out

    return run


def dedup_bytes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 400, gram: int = 100, most_kinds: int = 20_000) -> DataFrame:
    """Removes every byte covered by a ``width``-byte string that also starts elsewhere.

    Texts are taken whole, as UTF-8; the other start may be in the same document, overlapping,
    or in another row; strings are judged on the input. Result: doc_id, n (bytes), removed,
    spans (maximal removed runs, begin and end in bytes), kept (binary). A null text is empty and
    keeps nothing; rows that repeat a text of ``width`` bytes or more lose all of it, shorter ones
    keep it; an empty table gives no rows. Other columns are ignored.

    ``gram`` bytes make an anchor (smaller: fewer anchors, more of them shared by chance);
    groups of more than ``most_kinds`` kinds of context are counted over the cluster.
    """
    return remove_repeats(df, id_column, text_column, BYTES, resolver(width, gram), width, gram, most_kinds)
