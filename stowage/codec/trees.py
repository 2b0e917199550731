"""Code lengths, canonical codes and the coding of length tables."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np

from stowage.codec.bits import CodecError, Fields, Reader

LIMIT = 15
LENGTH_LIMIT = 7
#: Bits by which symbols are looked up at once; longer codes are rare.
NEAR = 10
#: The order in which the lengths of the length alphabet are written.
LENGTH_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)
PLACE = {symbol: place for place, symbol in enumerate(LENGTH_ORDER)}
#: Least repetitions and extra bits of the run symbols.
RUNS = {16: (3, 2), 17: (3, 3), 18: (11, 7)}


def code_lengths(freqs, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` for the frequencies, by package-merge.

    Unused symbols get 0, a single used one gets 1. On equal weights packages
    come before symbols, and symbols by their number.
    """
    freqs = np.asarray(freqs, np.int64)
    used = np.flatnonzero(freqs)
    out = np.zeros(len(freqs), np.int64)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise CodecError("too many symbols for the length limit")
    order = used[np.argsort(freqs[used], kind="stable")]
    items = freqs[order]
    is_item, row = [], items
    kinds = np.ones(len(items), bool)
    for _ in range(limit):
        is_item.append(kinds)
        half = len(row) // 2
        packages = row[: 2 * half].reshape(half, 2).sum(1)
        both = np.concatenate([packages, items])
        merged = np.argsort(both, kind="stable")
        row, kinds = both[merged], merged >= half
    depth = np.zeros(len(items), np.int64)
    take = 2 * len(items) - 2
    for kinds in reversed(is_item):
        own = int(kinds[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    out[order] = depth
    return out


def valid(lengths, limit: int = LIMIT) -> bool:
    """Whether the lengths make a full prefix code, or a code of one symbol or none."""
    used = np.asarray(lengths, np.int64)
    used = used[used > 0]
    return len(used) <= 1 or bool((used <= limit).all()) and int((1 << (limit - used)).sum()) == 1 << limit


def canonical(lengths, limit: int = LIMIT) -> np.ndarray:
    """Canonical codes by (length, symbol): each is the sum of the code space that lies before it."""
    lengths = np.asarray(lengths, np.int64)
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    space = 1 << (limit - lengths[order])
    out[order] = (np.cumsum(space) - space) >> (limit - lengths[order])
    return out


def lookup(lengths, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for each ``limit``-bit prefix; length 0 where none begins so."""
    if not valid(lengths, limit):
        raise CodecError("code lengths don't make a full code")
    lengths = np.asarray(lengths, np.int64)
    symbols, sizes = np.zeros(1 << limit, np.int32), np.zeros(1 << limit, np.int32)
    codes = canonical(lengths, limit)
    for s in np.flatnonzero(lengths):
        n = int(lengths[s])
        span = slice(int(codes[s]) << (limit - n), (int(codes[s]) + 1) << (limit - n))
        symbols[span], sizes[span] = s, n
    return symbols, sizes


class Table:
    """A code for loops in Python: ``near[first NEAR bits]``, or where that is 0 ``far(first LIMIT bits)``, is ``symbol << 4 | length``."""

    def __init__(self, lengths, limit: int = LIMIT) -> None:
        if not valid(lengths, limit):
            raise CodecError("code lengths don't make a full code")
        lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        self.limit = limit
        self.entries, sizes = (order << 4 | lengths[order]).tolist(), lengths[order].tolist()
        self.near: list[int] = []
        for entry, n in zip(self.entries, sizes, strict=True):
            if n > NEAR:
                break
            self.near += [entry] * (1 << (NEAR - n))
        self.near += [0] * ((1 << NEAR) - len(self.near))
        self.ends = np.cumsum(1 << (limit - lengths[order])).tolist()

    def far(self, prefix: int) -> int:
        """The same by a search; fails where no code begins so."""
        place = bisect_right(self.ends, prefix)
        if place == len(self.entries):
            raise CodecError("invalid code")
        return self.entries[place]


def runs(lengths) -> list[tuple[int, int]]:
    """(length, repetitions) of the runs of equal lengths."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return []
    starts = np.concatenate([[0], np.flatnonzero(np.diff(lengths)) + 1])
    return [(int(lengths[s]), int(n)) for s, n in zip(starts, np.diff(np.append(starts, len(lengths))), strict=True)]


def run_symbols(length: int, count: int) -> list[tuple[int, int]]:
    """(symbol, repetitions it stands for) that code a run."""
    if length:
        full, rest = divmod(count - 1, 6)
        return [(length, 1)] + [(16, 6)] * full + ([(16, rest)] if rest >= 3 else [(length, 1)] * rest)
    full, rest = divmod(count, 138)
    tail = [(18, rest)] if rest >= 11 else [(17, rest)] if rest >= 3 else [(0, 1)] * rest
    return [(18, 138)] * full + tail


def write_lengths(fields: Fields, lengths) -> None:
    """The length section: the lengths of the length alphabet, then runs of lengths."""
    symbols = [s for r in runs(lengths) for s in run_symbols(*r)]
    freqs = np.zeros(19, np.int64)
    for s, n in symbols:
        freqs[PLACE[s]] += 1
        # the format's encoder counts a long run of zeros for symbol 17, too
        if s == 18 and n < 138:
            freqs[PLACE[17]] += 1
    own = code_lengths(freqs, LENGTH_LIMIT)
    codes = canonical(own, LENGTH_LIMIT)
    n_codes = max(4, int(np.flatnonzero(own).max(initial=-1)) + 1)
    values, widths = [n_codes - 4, *own[:n_codes].tolist()], [4] + [3] * n_codes
    code_of, width_of = codes.tolist(), own.tolist()
    for s, n in symbols:
        place = PLACE[s]
        values.append(code_of[place])
        widths.append(width_of[place])
        if s in RUNS:
            least, extra = RUNS[s]
            values.append(n - least)
            widths.append(extra)
    fields.add(values, widths)


def read_lengths(reader: Reader, count: int) -> np.ndarray:
    """``count`` lengths from a length section."""
    n_codes = reader.read(4) + 4
    if n_codes > 19:
        raise CodecError("too many length codes")
    own = np.zeros(19, np.int64)
    own[:n_codes] = [reader.read(3) for _ in range(n_codes)]
    if not valid(own, LENGTH_LIMIT):
        raise CodecError("length codes don't make a full code")
    found = Table(own, LENGTH_LIMIT)
    # the section as one number: it takes at most 14 bits for each length
    bits = 14 * count + 64
    ahead, left, mask = reader.ahead(bits), bits, (1 << LENGTH_LIMIT) - 1
    out: list[int] = []
    while len(out) < count:
        entry = found.far(ahead >> (left - LENGTH_LIMIT) & mask)
        left -= entry & 15
        symbol = LENGTH_ORDER[entry >> 4]
        if symbol not in RUNS:
            out.append(symbol)
            continue
        least, extra = RUNS[symbol]
        left -= extra
        repeat = least + (ahead >> left & ((1 << extra) - 1))
        if symbol == 16 and not out or len(out) + repeat > count:
            raise CodecError("invalid repetition of code lengths")
        out += [out[-1] if symbol == 16 else 0] * repeat
    reader.skip(bits - left)
    return np.array(out, np.int64)
