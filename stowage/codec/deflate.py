"""Blocks of LZ77 tokens under two dynamic Huffman codes."""

from __future__ import annotations

import numpy as np

from stowage.codec import lz77
from stowage.codec.bits import WORD, CodecError, Fields, Reader, words
from stowage.codec.trees import LIMIT, NEAR, Table, canonical, code_lengths, read_lengths, write_lengths

END = 256
FINAL, DYNAMIC = 0b100, 0b010
LITLEN, DIST = 286, 30
#: Bytes looked at together when decoding.
SEGMENT = 4096
_NEAR, _FAR = (1 << NEAR) - 1, (1 << LIMIT) - 1
#: (least value, extra bits) of the symbols.
_LENGTHS = list(zip(lz77.LENGTH_BASE.tolist(), lz77.LENGTH_EXTRA.tolist(), strict=True))
_DISTANCES = list(zip(lz77.DISTANCE_BASE.tolist(), lz77.DISTANCE_EXTRA.tolist(), strict=True))


def _stripped(lengths: np.ndarray, least: int) -> np.ndarray:
    return lengths[: max(least, int(np.flatnonzero(lengths).max(initial=-1)) + 1)]


def encode(raw: bytes, level: int, final: bool) -> bytes:
    size, back = lz77.tokens(raw, level)
    match = back > 0
    size_symbol = lz77.length_symbol(np.where(match, size, lz77.MIN_MATCH))
    back_symbol = lz77.distance_symbol(np.where(match, back, 1))
    symbol = np.append(np.where(match, size_symbol + 257, size), END)
    lengths = _stripped(code_lengths(np.bincount(symbol, minlength=LITLEN)), 257)
    dist_lengths = _stripped(code_lengths(np.bincount(back_symbol[match], minlength=DIST)), 1)
    fields = Fields()
    fields.add([DYNAMIC | FINAL * final, len(lengths) - 257, len(dist_lengths) - 1], [3, 5, 5])
    write_lengths(fields, np.concatenate([lengths, dist_lengths]))
    codes, dist_codes = canonical(lengths), canonical(dist_lengths)
    # four columns a token: symbol, extra length bits, distance, extra distance bits
    values, widths = np.zeros((len(size) + 1, 4), np.int64), np.zeros((len(size) + 1, 4), np.int64)
    values[:, 0], widths[:, 0] = codes[symbol], lengths[symbol]
    at = np.flatnonzero(match)
    s, d = size_symbol[at], back_symbol[at]
    values[at, 1], widths[at, 1] = size[at] - lz77.LENGTH_BASE[s], lz77.LENGTH_EXTRA[s]
    if len(at):
        values[at, 2], widths[at, 2] = dist_codes[d], dist_lengths[d]
    values[at, 3], widths[at, 3] = back[at] - lz77.DISTANCE_BASE[d], lz77.DISTANCE_EXTRA[d]
    fields.add(values.ravel(), widths.ravel())
    return fields.bytes()


def head(data: bytes, byte: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Of the block at ``byte`` the bit where its tokens begin, and the code lengths of its two alphabets."""
    reader = Reader(data, byte)
    if reader.read(3) & 0b011 != DYNAMIC:
        raise CodecError("unsupported block type")
    n_lengths, n_dist = reader.read(5) + 257, reader.read(5) + 1
    if n_lengths > LITLEN or n_dist > DIST:
        raise CodecError("too many codes")
    both = read_lengths(reader, n_lengths + n_dist)
    return reader.at, both[:n_lengths], both[n_lengths:]


def joined(value: np.ndarray, distance: np.ndarray) -> bytes:
    """The bytes of a block's tokens: literals have distance 0."""
    match = distance > 0
    literals = value[~match].astype(np.uint8).tobytes()
    gaps = np.cumsum(~match)[match]
    try:
        return lz77.expand(value[match].tolist(), distance[match].tolist(), gaps.tolist(), literals)
    except ValueError as e:
        raise CodecError(str(e)) from None


def decode(data: bytes, byte: int, size: int) -> tuple[bytes, int]:
    """The block at ``byte`` and the byte where it ends."""
    at, lengths_of, dist_lengths = head(data, byte)
    found, dist_found = Table(lengths_of), Table(dist_lengths)
    near, dist_near = found.near, dist_found.near
    out, base, here, done = bytearray(), at >> 3, at & 7, False
    put = out.append
    while not done:
        limit = min(8 * SEGMENT, 8 * (len(data) - base))
        if here >= limit:
            raise CodecError("unexpected end of data")
        ahead = words(data[base : base + SEGMENT + 8])
        while here < limit:
            # a token takes at most 48 bits; several literals are taken from one word
            word, left = ahead[here >> 3], WORD + 7 - (here & 7)
            top = here + left
            while left >= LIMIT:
                entry = near[word >> left - NEAR & _NEAR] or found.far(word >> left - LIMIT & _FAR)
                if entry >= END << 4:
                    break
                left -= entry & 15
                put(entry >> 4)
            else:
                here = top - left
                continue
            here = top - left
            if here >= limit:
                break
            word, left = ahead[here >> 3], WORD + 7 - (here & 7)
            top = here + left
            left -= entry & 15
            symbol = entry >> 4
            if symbol == END:
                here, done = top - left, True
                break
            length, extra = _LENGTHS[symbol - 257]
            if extra:
                left -= extra
                length += word >> left & (1 << extra) - 1
            entry = dist_near[word >> left - NEAR & _NEAR] or dist_found.far(word >> left - LIMIT & _FAR)
            left -= entry & 15
            back, extra = _DISTANCES[entry >> 4]
            if extra:
                left -= extra
                back += word >> left & (1 << extra) - 1
            here = top - left
            start = len(out) - back
            if start < 0:
                raise CodecError("a match that begins before the block")
            if back >= length:
                out += out[start : start + length]
            else:
                out += (out[start:] * (length // back + 1))[:length]
        if len(out) > size:
            raise CodecError("more data than a block holds")
        if here >= 8 * SEGMENT and not done:
            base, here = base + SEGMENT, here - 8 * SEGMENT
    end = base + (here + 7 >> 3)
    if end > len(data):
        raise CodecError("unexpected end of data")
    return bytes(out), end
