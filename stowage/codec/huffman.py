"""Blocks of Huffman-coded bytes."""

from __future__ import annotations

import numpy as np

from stowage.codec.bits import WORD, CodecError, Fields, Reader, words
from stowage.codec.trees import LIMIT, NEAR, Table, canonical, code_lengths, read_lengths, write_lengths

END = 256
#: Bytes looked at together when decoding.
SEGMENT = 4096
_NEAR, _FAR = (1 << NEAR) - 1, (1 << LIMIT) - 1


def encode(raw: bytes, level: int, final: bool) -> bytes:
    """A block; only a final one has the end symbol."""
    data = np.frombuffer(raw, np.uint8).astype(np.int64)
    if final:
        data = np.append(data, END)
    lengths = code_lengths(np.bincount(data, minlength=257))
    codes = canonical(lengths)
    fields = Fields()
    write_lengths(fields, lengths)
    fields.add(codes[data], lengths[data])
    return fields.bytes()


def decode(data: bytes, byte: int, size: int) -> tuple[bytes, int]:
    """The block at ``byte``, and the byte where it ends: at its end symbol or after ``size`` bytes."""
    reader = Reader(data, byte)
    found = Table(read_lengths(reader, 257))
    near, out, base, at, room, ended = found.near, bytearray(), reader.at >> 3, reader.at & 7, size, False
    put = out.append
    while room and not ended:
        limit = min(8 * SEGMENT, 8 * (len(data) - base))
        if at >= limit:
            raise CodecError("unexpected end of data")
        ahead = words(data[base : base + SEGMENT + 8])
        while at < limit and room:
            # several symbols are taken from one word
            word, left = ahead[at >> 3], WORD + 7 - (at & 7)
            top, before = at + left, len(out)
            # one by one where the block may be full within the word
            least = LIMIT if room > WORD + 7 else left
            while left >= least:
                entry = near[word >> left - NEAR & _NEAR] or found.far(word >> left - LIMIT & _FAR)
                left -= entry & 15
                if entry >= END << 4:
                    ended = True
                    break
                put(entry >> 4)
            at = top - left
            room -= len(out) - before
            if ended:
                break
        if at >= 8 * SEGMENT:
            base, at = base + SEGMENT, at - 8 * SEGMENT
    end = base + (at + 7 >> 3)
    if end > len(data):
        raise CodecError("unexpected end of data")
    return bytes(out), end
