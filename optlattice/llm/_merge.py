"""Byte-pair merges on flat numpy arrays that hold the symbols of many words."""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.iinfo(np.int64).max
_SHIFT = 21
#: Symbols beyond which a word is merged rank by rank: a round then costs as much as it merges, not as much as the word is long.
LONG = 256


class PairTable:
    """Sorted pair keys with the rank and the merged symbol of each pair.

    A merged symbol is `plain` when every pair that it takes part in ranks after its own: all its places in a
    word can then be merged at once. The few others are merged one place at a time.
    """

    def __init__(self, left, right, rank, merged):
        left, right, rank, merged = (np.asarray(x, dtype=np.int64) for x in (left, right, rank, merged))
        keys = left << _SHIFT | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], rank[order], merged[order]
        top = int(max(left.max(initial=0), right.max(initial=0), merged.max(initial=0))) + 1
        if top >= 1 << _SHIFT:
            raise ValueError("too many symbols for the pair keys")
        first = np.full(top, NONE)
        np.minimum.at(first, left, rank)
        np.minimum.at(first, right, rank)
        made = np.zeros(top, dtype=np.int64)
        np.maximum.at(made, merged, rank)
        self.plain = first > made

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs (NONE: no such pair) and their places in the table, by binary search."""
        key = left << _SHIFT | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NONE), at


def merge(symbols: np.ndarray, counts: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Applies each word's lowest-ranked pair in all words at once, round after round, until no word has a pair.

    symbols holds the words one after the other and counts the symbols of each. Returns the same two for the
    results. A negative symbol joins no pair. Words without a pair leave the arrays at the end of a round; long words
    are merged by merge_long().
    """
    long = np.asarray(counts) > LONG
    if long.any():
        return _merge_both(symbols, np.asarray(counts, dtype=np.int64), table, long)
    n_words = len(counts)
    final = np.array(counts, dtype=np.int64)
    done_word, done_symbols = [], []
    word = np.repeat(np.arange(n_words), counts)
    symbols = symbols.astype(np.int64)
    rank, at = _pair_ranks(symbols, word, table)
    while len(symbols):
        begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[begin, len(word)])
        low = np.minimum.reduceat(rank, begin)
        over = low == NONE
        if over.any():
            ended = np.repeat(over, size)
            done_word.append(word[ended])
            done_symbols.append(symbols[ended])
            final[word[begin[over]]] = size[over]
            stay = ~ended
            symbols, word, rank, at = symbols[stay], word[stay], rank[stay], at[stay]
            begin, size, low = None, size[~over], low[~over]
            if not len(symbols):
                break
        place = np.flatnonzero(rank == np.repeat(low, size))
        place = _apart(place, word, table.plain[table.merged[at[place]]])
        symbols[place] = table.merged[at[place]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[place + 1] = False
        moved = place - np.arange(len(place))
        symbols, word, rank, at = symbols[keep], word[keep], rank[keep], at[keep]
        # only pairs with a new symbol have another rank
        touched = np.unique(np.r_[moved, moved[moved > 0] - 1])
        rank[touched], at[touched] = _pair_ranks(symbols, word, table, touched)
    if not done_word:
        return symbols, final
    word, symbols = np.concatenate(done_word), np.concatenate(done_symbols)
    return symbols[np.argsort(word, kind="stable")], final


def _merge_both(symbols, counts, table, long):
    """merge() of the short words and merge_long() of the others, in the words' order."""
    of_long = np.repeat(long, counts)
    flat_long, n_long = merge_long(symbols[of_long], counts[long], table)
    flat, n = merge(symbols[~of_long], counts[~long], table)
    final = np.zeros(len(counts), dtype=np.int64)
    final[long], final[~long] = n_long, n
    where, out = np.repeat(long, final), np.empty(int(final.sum()), dtype=np.int64)
    out[where], out[~where] = flat_long, flat
    return out, final


def merge_long(symbols: np.ndarray, counts: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """merge() for long words: the lowest rank of all words at a time, at all its places.

    Places of pairs wait by rank, and symbols are linked with those beside them, so a round touches only the places
    that it merges and the pairs around them: no round is as long as the words. Where a merged symbol isn't plain,
    its places are merged one by one, from the left.
    """
    word = np.repeat(np.arange(len(counts)), counts)
    n = len(word)
    symbol = np.r_[symbols.astype(np.int64), -1]  # the last one stands for what is beyond a word
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    last = np.flatnonzero(np.r_[word[1:] != word[:-1], True]) if n else np.zeros(0, dtype=np.int64)
    after[last] = n
    before[np.r_[0, last[:-1] + 1][: len(last)]] = n
    rank, at, alive = np.full(n, NONE), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    waiting: dict[int, list] = {}
    order: list[int] = []

    def find(places: np.ndarray) -> None:
        """Ranks the pairs that begin at the places, and lets them wait."""
        left, right = symbol[places], symbol[after[places]]
        found, where = table.find(np.maximum(left, 0), np.maximum(right, 0))
        found[(left < 0) | (right < 0)] = NONE
        rank[places], at[places] = found, where
        some = np.flatnonzero(found != NONE)
        some = some[np.argsort(found[some], kind="stable")]
        cut = np.flatnonzero(np.diff(found[some])) + 1
        for part in np.split(some, cut) if len(some) else []:
            r = int(found[part[0]])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(order, r)
            if table.plain[table.merged[where[part[0]]]]:
                waiting[r].append(places[part])
            else:
                for p in places[part].tolist():
                    heapq.heappush(waiting[r], p)

    find(np.arange(n))
    while order:
        r = order[0]
        here = waiting[r]
        if here and isinstance(here[0], int):
            place = np.array([heapq.heappop(here)])
            place = place[rank[place] == r]
        else:
            place = np.unique(np.concatenate(here)) if here else np.zeros(0, dtype=np.int64)
            here.clear()
            place = place[rank[place] == r]
            place = _alternate(place, after)
        if not here:
            heapq.heappop(order)
            del waiting[r]
        if not len(place):
            continue
        gone = after[place]
        symbol[place] = table.merged[at[place]]
        rank[gone], alive[gone] = NONE, False
        beyond = after[gone]
        after[place], before[beyond] = beyond, place
        before[n] = n
        left = before[place]
        find(np.unique(np.r_[place, left[left < n]]))
    return symbol[:n][alive], np.bincount(word[alive], minlength=len(counts))


def _alternate(place: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Leaves out places whose pair begins with the second symbol of the one before them: every second one of a run."""
    linked = np.r_[False, after[place[:-1]] == place[1:]] if len(place) else np.zeros(0, dtype=bool)
    index = np.arange(len(place))
    run = np.maximum.accumulate(np.where(linked, 0, index)) if len(place) else index
    return place[(index - run) % 2 == 0]


def _pair_ranks(symbols, word, table, places=None):
    """Rank and table place of the pair that begins at each place; NONE at a word's end."""
    places = np.arange(len(symbols)) if places is None else places
    after = np.minimum(places + 1, len(symbols) - 1)
    left, right = symbols[places], symbols[after]
    rank, at = table.find(np.maximum(left, 0), np.maximum(right, 0))
    rank[(after == places) | (word[places] != word[after]) | (left < 0) | (right < 0)] = NONE
    return rank, at


def _apart(place, word, plain):
    """Leaves out places that overlap the one before them, and all but a word's first where the symbol isn't plain."""
    linked = np.r_[False, (np.diff(place) == 1) & (word[place[1:]] == word[place[:-1]])]
    index = np.arange(len(place))
    run = np.maximum.accumulate(np.where(linked, 0, index))
    first = np.r_[True, word[place[1:]] != word[place[:-1]]]
    return place[((index - run) % 2 == 0) & (plain | first)]

