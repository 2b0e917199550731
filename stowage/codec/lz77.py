"""Matches of a block with what stands before in it, and the symbols for lengths and distances."""

from __future__ import annotations

import numpy as np

from stowage.codec.levels import LAZY_THRESHOLDS

MIN_MATCH, MAX_MATCH, MAX_DISTANCE = 3, 258, 32768
#: How many earlier places are tried for each position, by level; at the highest all within ``MAX_DISTANCE``.
TRIES = (1, 2, 3, 4, 6, 8, 12, 16, MAX_DISTANCE)


def _bases(first: int, groups: int, per_group: int) -> tuple[np.ndarray, np.ndarray]:
    """(least value, extra bits): groups of symbols of which each next has one more extra bit."""
    extra = [0] * per_group + [g for g in range(groups) for _ in range(per_group)]
    base = first + np.concatenate([[0], np.cumsum(1 << np.array(extra))])[:-1]
    return base, np.array(extra)


def _length_symbols() -> tuple[np.ndarray, np.ndarray]:
    base, extra = _bases(MIN_MATCH, 6, 4)
    # the longest match has a symbol of its own
    return np.append(base[:28], MAX_MATCH), np.append(extra[:28], 0)


LENGTH_BASE, LENGTH_EXTRA = _length_symbols()
DISTANCE_BASE, DISTANCE_EXTRA = _bases(1, 14, 2)


def length_symbol(lengths: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTH_BASE, lengths, "right") - 1


def distance_symbol(distances: np.ndarray) -> np.ndarray:
    return np.searchsorted(DISTANCE_BASE, distances, "right") - 1


def longest(raw: bytes, tries: int, sizes: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(length, distance) of the best match at each position, over the nearest ``tries`` places that share three bytes.

    ``raw`` may be several blocks of the given ``sizes``; matches stay inside them.
    """
    n = len(raw)
    best, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n <= MIN_MATCH:
        return best, distance
    sizes = [n] if sizes is None else sizes
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
    plain = np.frombuffer(raw + bytes(8), np.uint8)
    data = plain.astype(np.uint64)
    eight = np.zeros(n + 1, np.uint64)
    for i in range(8):
        eight |= data[i : i + n + 1] << np.uint64(8 * i)
    # block, bytes and place as one number, while these fit it
    wide = n.bit_length()
    at = np.flatnonzero(left >= MIN_MATCH)
    keys = np.repeat(np.arange(len(sizes)), sizes)[at] << 24 | (eight[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    order = np.sort(keys << wide | at)
    keys, order = order >> wide, order & (1 << wide) - 1
    before = np.full(n, -1, np.int64)
    same = keys[1:] == keys[:-1]
    before[order[1:][same]] = order[:-1][same]
    room = np.minimum(MAX_MATCH, left)
    here = np.flatnonzero(before >= 0)
    there = before[here]
    for _ in range(tries):
        near = here - there <= MAX_DISTANCE
        here, there = here[near], there[near]
        if not len(here):
            break
        # only places that also agree where the best match so far ends can give a longer one
        ends = best[here]
        may = np.flatnonzero(plain[here + ends] == plain[there + ends])
        keep_here, keep_there = here, there
        here, there = here[may], there[may]
        length, open_ = np.zeros(len(here), np.int64), np.arange(len(here))
        while len(open_):
            at = length[open_]
            x = eight[here[open_] + at] ^ eight[there[open_] + at]
            whole = x == 0
            length[open_] += np.where(whole, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
            open_ = open_[whole]
            open_ = open_[length[open_] < room[here[open_]]]
        length = np.minimum(length, room[here])
        longer = length > best[here]
        best[here[longer]], distance[here[longer]] = length[longer], (here - there)[longer]
        here, there = keep_here, before[keep_there]
        keep = (there >= 0) & (best[here] < room[here])
        here, there = here[keep], there[keep]
    return best, distance


def tokens(raw: bytes, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, distance) of each token; a literal has its byte as length and distance 0."""
    return tokens_of([raw], level)[:2]


def tokens_of(raws: list[bytes], level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` of several blocks one after another, and how many each has."""
    raw, sizes = b"".join(raws), [len(r) for r in raws]
    best, distance = longest(raw, TRIES[level], sizes)
    # a match never ends beyond its block, so that each block begins with a token
    literal = (best < MIN_MATCH) | (best < LAZY_THRESHOLDS[level]) & (np.append(best[1:], 0) > best)
    # only the places of matches are walked: from each to the first at or behind its end
    places = np.flatnonzero(~literal)
    ends = places + best[places]
    following = np.append(0, np.cumsum(~literal))[ends].tolist()
    taken, i, n = [], 0, len(following)
    while i < n:
        taken.append(i)
        i = following[i]
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[places[taken] + 1] = 1
    inside[ends[taken]] = -1
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)
    hit = ~literal[at]
    plain = np.frombuffer(raw, np.uint8).astype(np.int64)[at]
    counts = np.diff(np.searchsorted(at, np.cumsum([0, *sizes])))
    return np.where(hit, best[at], plain), np.where(hit, distance[at], 0), counts


def expand(lengths: list[int], distances: list[int], gaps: list[int], literals: bytes) -> bytes:
    """The bytes of ``literals`` with a match after each of the given counts of literals."""
    out, at = bytearray(), 0
    for size, back, gap in zip(lengths, distances, gaps, strict=True):
        out += literals[at:gap]
        at = gap
        start = len(out) - back
        if start < 0:
            raise ValueError("a match that begins before the block")
        if back >= size:
            out += out[start : start + size]
        else:
            out += (out[start:] * (size // back + 1))[:size]
    return bytes(out + literals[at:])
