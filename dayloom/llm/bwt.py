"""Repeated strings of a bounded length in a set of short byte pieces, by a Burrows-Wheeler transform.

Runs inside one task over pieces that a shuffle has brought together.
"""

import numpy as np


def _sorted_suffixes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Suffix order by the first ``length`` symbols at least: prefix doubling over groups not yet single."""
    n = len(symbols)
    first, known = symbols, 1
    if n and symbols.max() < 1 << 16:  # four at once
        padded, known = np.r_[symbols, np.zeros(3, np.uint64)], 4
        first = (padded[:n] << np.uint64(48)) | (padded[1:n + 1] << np.uint64(32)) | (padded[2:n + 2] << np.uint64(16)) | padded[3:n + 3]
    order = np.argsort(first)  # the order of equals doesn't matter, here and below
    first = first[order]
    new = np.r_[True, first[1:] != first[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.arange(n)
    while known < length:
        start = rank[order[slots]]
        same = start[1:] == start[:-1]
        slots = slots[np.r_[same, False] | np.r_[False, same]]
        if not len(slots):
            break
        at = order[slots]
        after = np.where(at + known < n, rank[np.minimum(at + known, n - 1)] + 1, 0)
        key = (rank[at] << 32) | after
        by = np.argsort(key)
        order[slots], key = at[by], key[by]
        new = np.r_[True, key[1:] != key[:-1]]
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        known *= 2
    return order


def _spread(first: np.ndarray, size: np.ndarray):
    """Indices of all intervals one after the other, and the interval of each."""
    of = np.repeat(np.arange(len(first)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of], of


def short_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True at i where suffixes i - 1 and i of the order share fewer than ``length`` symbols.

    Breadth-first: the intervals of all strings of one length are extended backwards by every
    symbol that precedes them, which gives the intervals of the next length.  The right end of
    an interval seen for the first time is a common prefix of that length; ends come by
    increasing value, only intervals with a new end go on, and the search stops at ``length``.
    """
    n = len(order)
    before = symbols[order - 1].astype(np.int64)
    by_symbol = np.argsort(before.astype(np.uint16) if before.max(initial=0) < 1 << 16 else before, kind="stable")
    same = before[by_symbol][1:] == before[by_symbol][:-1]
    to = np.empty(n, np.int64)  # where an interval's row goes when its symbol is put in front
    to[by_symbol] = np.arange(n)
    following, preceding = np.full(n, -1), np.full(n, -1)  # a symbol's last row needs no end of its own
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    preceding[by_symbol[1:][same]] = by_symbol[:-1][same]
    first = symbols[order]
    done = np.r_[True, first[1:] != first[:-1], True]
    ends = np.flatnonzero(done)
    low, high = ends[:-1], ends[1:]
    for _ in range(length - 1):
        row, of = _spread(low, high - low)
        last = np.flatnonzero(following[row] >= high[of])
        last = last[~done[to[row[last]] + 1]]
        if not len(last):
            break
        # the first row of the same symbol in the same interval gives the new interval's left end
        head = np.flatnonzero(preceding[row] < low[of])
        heads, lasts = row[head], row[last]
        head_key, last_key = (of[head] << 32) | before[heads], (of[last] << 32) | before[lasts]
        by = np.argsort(head_key)
        left = to[heads[by[np.searchsorted(head_key, last_key, sorter=by)]]]
        right = to[lasts] + 1
        done[right] = True
        low, high = left, right
    return done


def repeated_starts(pieces: list[bytes], length: int, owners=None, words=False) -> np.ndarray:
    """For each byte of the joined pieces: does a string of ``length`` bytes start here, inside its piece, and elsewhere too?

    ``owners``: a number for each piece; elsewhere is then in a piece of another owner.  ``words``:
    a symbol is a word's code of 8 bytes, not a byte.
    """
    unit = 8 if words else 1
    sizes = np.array([len(p) // unit for p in pieces])
    if len(pieces) > 65000 or (len(sizes) and sizes.sum() > 1 << 30):
        raise ValueError("too much for one transform")
    joined = np.frombuffer(b"".join(p + bytes(unit) for p in pieces), "<u8" if words else np.uint8)
    known, joined = np.unique(joined, return_inverse=True) if words else (range(256), joined)
    joined = joined.astype(np.uint64)
    marks = np.cumsum(sizes + 1) - 1
    joined[marks] = len(known) + np.arange(len(pieces), dtype=np.uint64)  # no two ends are equal
    order = _sorted_suffixes(joined, length)
    alike = ~short_prefixes(joined, order, length)[:-1]
    out = np.zeros(len(joined), bool)
    if owners is not None and len(order):
        of = np.repeat(np.array(owners), sizes + 1)[order]
        first = np.flatnonzero(~alike)  # where a group of suffixes that begin alike begins
        mixed = np.minimum.reduceat(of, first) < np.maximum.reduceat(of, first)
        out[order[np.repeat(mixed, np.diff(np.r_[first, len(order)]))]] = True
        return np.delete(out, marks)
    out[order[alike]] = True
    out[order[np.flatnonzero(alike) - 1]] = True
    return np.delete(out, marks)
