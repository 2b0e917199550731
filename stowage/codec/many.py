"""Many blocks coded together, which shares numpy's cost per call among them. Bytes are those of ``encode`` block by block."""

from __future__ import annotations

import numpy as np

from stowage.codec import deflate, huffman, lz77
from stowage.codec.trees import LENGTH_LIMIT, LENGTH_ORDER, LIMIT, PLACE, RUNS

_PLACES = np.array([PLACE[s] for s in range(len(LENGTH_ORDER))])
_LEAST = np.array([RUNS.get(s, (0, 0))[0] for s in range(len(LENGTH_ORDER))])
_EXTRA = np.array([RUNS.get(s, (0, 0))[1] for s in range(len(LENGTH_ORDER))])
#: A weight beyond all others, of places without a symbol.
_NONE = 1 << 40
_SYMBOL = 9


def code_lengths(freqs: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """``trees.code_lengths`` of each row."""
    used = (freqs > 0).sum(1)
    n = int(used.max(initial=0))
    out = np.zeros(freqs.shape, np.int64)
    if not n:
        return out
    keys = np.sort(np.where(freqs > 0, freqs, _NONE) << _SYMBOL | np.arange(freqs.shape[1]), 1)[:, :n]
    # a weight and whether it is a symbol's as one number: of equal weights packages come first, and equals need no order
    items = keys >> _SYMBOL << 1 | 1
    row, kinds = items, []
    for _ in range(limit):
        kinds.append((row & 1).astype(bool) & (row < _NONE))
        half = row.shape[1] // 2
        packages = (row[:, : 2 * half : 2] >> 1) + (row[:, 1 : 2 * half : 2] >> 1) << 1
        row = np.sort(np.concatenate([packages, items], 1), 1)
    depth, places, take = np.zeros(items.shape, np.int64), np.arange(n), 2 * used - 2
    rows = np.arange(len(freqs))
    for kind in reversed(kinds):
        before = np.cumsum(kind, 1, dtype=np.int32)
        own = np.where(take > 0, before[rows, np.clip(take, 1, kind.shape[1]) - 1], 0)
        depth += own[:, None] > places
        take = 2 * (take - own)
    depth[used == 1, 0] = 1
    np.put_along_axis(out, keys & (1 << _SYMBOL) - 1, np.where(places < used[:, None], depth, 0), 1)
    return out


def canonical(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """``trees.canonical`` of each row."""
    symbols = lengths.shape[1]
    keys = np.sort(np.where(lengths > 0, lengths, limit + 1) * symbols + np.arange(symbols), 1)
    size = keys // symbols
    space = np.where(size <= limit, 1 << np.maximum(limit - size, 0), 0)
    out = np.zeros(lengths.shape, np.int64)
    np.put_along_axis(out, keys % symbols, (np.cumsum(space, 1) - space) >> np.maximum(limit - size, 0), 1)
    return np.where(lengths > 0, out, 0)


def _end(lengths: np.ndarray, least: int) -> np.ndarray:
    """Of each row how many lengths there are without the zeros at its end."""
    used = lengths > 0
    return np.maximum(least, np.where(used.any(1), lengths.shape[1] - np.argmax(used[:, ::-1], 1), 0))


class _Streams:
    """Groups of fields for several blocks, each group behind the one before it in every block."""

    def __init__(self, blocks: int) -> None:
        self.used = np.zeros(blocks, np.int64)
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, owner: np.ndarray, values: np.ndarray, widths: np.ndarray) -> None:
        """Fields in the order of their blocks."""
        owner, values, widths = owner[widths > 0], values[widths > 0], widths[widths > 0]
        bits = np.bincount(owner, widths, len(self.used)).astype(np.int64)
        at = np.cumsum(widths) - widths + (self.used - (np.cumsum(bits) - bits))[owner]
        self.groups.append((owner, values, np.stack([at, widths])))
        self.used += bits

    def columns(self, owner: np.ndarray, values: np.ndarray, widths: np.ndarray) -> None:
        self.add(np.repeat(owner, values.shape[1]), values.ravel(), widths.ravel())

    def bytes(self) -> list[bytes]:
        ends = np.cumsum(self.used + 7 >> 3)
        begins = ends - (self.used + 7 >> 3)
        bits = np.zeros(8 * int(ends[-1]), np.uint8)
        for owner, values, (at, widths) in self.groups:
            total = int(widths.sum())
            offset = np.arange(total, dtype=np.int32) - np.repeat((np.cumsum(widths) - widths).astype(np.int32), widths)
            place = np.repeat((8 * begins[owner] + at).astype(np.int32), widths) + offset
            below = np.repeat((widths - 1).astype(np.int32), widths) - offset
            bits[place] = np.repeat(values.astype(np.int32), widths) >> below & 1
        data = np.packbits(bits).tobytes()
        return [data[b:e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]


def _write_lengths(out: _Streams, owner: np.ndarray, lengths: np.ndarray, blocks: int) -> None:
    """``trees.write_lengths`` for the lengths of several blocks."""
    first = np.append(True, (np.diff(lengths) != 0) | (np.diff(owner) != 0))
    at = np.flatnonzero(first)
    size, whose, count = lengths[at], owner[at], np.diff(np.append(at, len(lengths)))
    # up to four kinds of symbols a run: (symbol, lengths it stands for, how often)
    full, rest = np.divmod(count - 1, 6)
    zeros, left = np.divmod(count, 138)
    zero, one, six = size == 0, np.ones_like(size), np.full_like(size, 6)
    kinds = np.where(zero, [18 * one, 18 * one, 17 * one, 0 * one], [size, 16 * one, 16 * one, size])
    stands = np.where(zero, [138 * one, left, left, one], [one, six, rest, one])
    times = np.where(zero, [zeros, left >= 11, (left >= 3) & (left < 11), np.where(left < 3, left, 0)], [one, full, rest >= 3, np.where(rest < 3, rest, 0)])
    times = times.T.ravel()
    s, n, whose = np.repeat(kinds.T.ravel(), times), np.repeat(stands.T.ravel(), times), np.repeat(np.repeat(whose, 4), times)
    wide = len(LENGTH_ORDER)
    freqs = np.bincount(whose * wide + _PLACES[s], minlength=blocks * wide).reshape(blocks, wide)
    # the format's encoder counts a long run of zeros for symbol 17, too
    freqs[:, PLACE[17]] += np.bincount(whose[(s == 18) & (n < 138)], minlength=blocks)
    own = code_lengths(freqs, LENGTH_LIMIT)
    codes, n_codes = canonical(own, LENGTH_LIMIT), _end(own, 4)
    every = np.arange(blocks)
    out.columns(every, np.column_stack([n_codes - 4, own]), np.column_stack([np.full(blocks, 4), np.where(np.arange(wide) < n_codes[:, None], 3, 0)]))
    out.columns(whose, np.column_stack([codes[whose, _PLACES[s]], n - _LEAST[s]]), np.column_stack([own[whose, _PLACES[s]], _EXTRA[s]]))


def encode_huffman(raws: list[bytes], level: int, finals: list[bool]) -> list[bytes]:
    blocks, wide = len(raws), huffman.END + 1
    every, final = np.arange(blocks), np.array(finals, bool)
    data = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
    owner = np.repeat(every, [len(r) for r in raws])
    freqs = np.bincount(owner * wide + data, minlength=blocks * wide).reshape(blocks, wide)
    freqs[:, huffman.END] = final
    lengths = code_lengths(freqs)
    codes = canonical(lengths)
    out = _Streams(blocks)
    _write_lengths(out, np.repeat(every, wide), lengths.ravel(), blocks)
    out.add(owner, codes[owner, data], lengths[owner, data])
    out.add(every, codes[:, huffman.END], lengths[:, huffman.END])
    return out.bytes()


def encode_deflate(raws: list[bytes], level: int, finals: list[bool]) -> list[bytes]:
    blocks = len(raws)
    every = np.arange(blocks)
    size, back, counts = lz77.tokens_of(raws, level)
    owner, match = np.repeat(every, counts), back > 0
    at = np.flatnonzero(match)
    s, d = lz77.length_symbol(size[at]), lz77.distance_symbol(back[at])
    symbol = size.copy()
    symbol[at] = s + 257
    freqs = np.bincount(owner * deflate.LITLEN + symbol, minlength=blocks * deflate.LITLEN).reshape(blocks, deflate.LITLEN)
    freqs[:, deflate.END] = 1
    lengths = code_lengths(freqs)
    dist_lengths = code_lengths(np.bincount(owner[at] * deflate.DIST + d, minlength=blocks * deflate.DIST).reshape(blocks, deflate.DIST))
    codes, dist_codes = canonical(lengths), canonical(dist_lengths)
    n, n_dist = _end(lengths, 257), _end(dist_lengths, 1)
    out = _Streams(blocks)
    heads = np.column_stack([deflate.DYNAMIC | deflate.FINAL * np.array(finals, np.int64), n - 257, n_dist - 1])
    out.columns(every, heads, np.broadcast_to([3, 5, 5], heads.shape))
    kept = np.column_stack([np.arange(deflate.LITLEN) < n[:, None], np.arange(deflate.DIST) < n_dist[:, None]])
    _write_lengths(out, np.repeat(every, kept.sum(1)), np.column_stack([lengths, dist_lengths])[kept], blocks)
    # four columns a token: symbol, extra length bits, distance, extra distance bits
    values, widths = np.zeros((len(size), 4), np.int64), np.zeros((len(size), 4), np.int64)
    values[:, 0], widths[:, 0] = codes[owner, symbol], lengths[owner, symbol]
    values[at, 1], widths[at, 1] = size[at] - lz77.LENGTH_BASE[s], lz77.LENGTH_EXTRA[s]
    values[at, 2], widths[at, 2] = dist_codes[owner[at], d], dist_lengths[owner[at], d]
    values[at, 3], widths[at, 3] = back[at] - lz77.DISTANCE_BASE[d], lz77.DISTANCE_EXTRA[d]
    out.columns(owner, values, widths)
    out.add(every, codes[:, deflate.END], lengths[:, deflate.END])
    return out.bytes()
