"""Removal of word sequences that repeat, by fixed-block anchors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import U64, mix, prefix_hash, ranges, span_hash
from .repeats import ODD, WORDS, Groups, remove_repeats


def keyed(group: np.ndarray, place: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One number for a hash at a place of a group."""
    return mix(h + mix(group.astype(U64) * ODD + place.astype(U64)))


def resolver(width: int):
    """Repeats of ``width`` words among the contexts of a group, from indexed blocks.

    Non-overlapping blocks of (width + 1) / 2 words of each context are indexed; every window of
    ``width`` words holds a whole one. Each rolling window of a block's length of all contexts
    probes the index, at its distance from the anchor. Hits in more than one context, or in one
    that occurs more than once, are extended: the windows around them that are equal over ``width`` words, and those side by
    side make up the maximal exact repeat. Members of a block are extended together, by
    the hash of what they cover, never pair by pair; windows called equal are compared word by word.
    """
    block = (width + 1) // 2

    def run(x: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prefix = prefix_hash(x.values)
        size = np.diff(x.at)
        many = np.maximum(size - block + 1, 0)
        start = ranges(x.at[:-1], many)
        who = np.repeat(np.arange(len(size)), many)
        inside = start - x.at[who]
        probe = keyed(x.group[who], inside - x.left[who], span_hash(prefix, start, np.full(len(start), block)))
        index = np.unique(probe[inside % block == 0])
        slot = np.minimum(np.searchsorted(index, probe), max(len(index) - 1, 0))
        known = index[slot] == probe if len(index) else np.zeros(len(probe), bool)
        # a context that occurs n times hits its own blocks n times
        seen = np.bincount(slot[known], x.copies[who[known]], len(index))
        hit = known & (seen[slot] > 1)
        # windows around a hit
        near = np.zeros(len(x.values) + 2, np.int64)
        low = np.maximum(start[hit] - (width - block), x.at[who[hit]])
        high = np.minimum(start[hit], x.at[who[hit] + 1] - width) + 1
        ok = low < high
        np.add.at(near, low[ok], 1)
        np.add.at(near, high[ok], -1)
        first = np.flatnonzero(np.cumsum(near)[: len(x.values)] > 0)
        who = np.searchsorted(x.at, first, side="right") - 1
        place = first - x.at[who] - x.left[who]
        key = keyed(x.group[who], place, span_hash(prefix, first, np.full(len(first), width)))
        order = np.argsort(key, kind="stable")
        key, first, who, place = key[order], first[order], who[order], place[order]
        same = key[1:] == key[:-1]
        for at in range(0, len(same), 1 << 16):
            pair = np.flatnonzero(same[at : at + (1 << 16)]) + at
            steps = np.arange(width)
            equal = (x.values[first[pair][:, None] + steps] == x.values[first[pair + 1][:, None] + steps]).all(axis=1)
            same[pair] = equal & (x.group[who[pair]] == x.group[who[pair + 1]]) & (place[pair] == place[pair + 1])
        twice = x.copies[who] > 1
        twice[:-1] |= same
        twice[1:] |= same
        who, place = who[twice], place[twice]
        order = np.lexsort((place, who))
        who, place = who[order], place[order]
        if not len(who):
            return who, place, place
        new = np.concatenate([[True], (who[1:] != who[:-1]) | (place[1:] > place[:-1] + width)])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(who)) - 1
        return who[at], place[at], place[last] + width

    return run


def dedup_words(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 35, gram: int = 10, most_kinds: int = 20_000) -> DataFrame:
    """Removes every word covered by a window of ``width`` words whose sequence also starts elsewhere.

    Words are the runs of other characters than space, tab, line feed, vertical tab, form feed
    and carriage return, unchanged, of whole texts. The other start may be in the same document,
    overlapping, or in another row; windows are judged on the input. Result: doc_id, n (words),
    removed, spans (maximal removed runs, begin and end in words), kept (UTF-8, words joined by
    one space). A null or blank text has no words; rows that repeat a text of ``width`` words or
    more lose all of it; an empty table gives no rows. Other columns are ignored.
    """
    return remove_repeats(df, id_column, text_column, WORDS, resolver(width), width, gram, most_kinds)
