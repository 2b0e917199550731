"""Decoding the LZ77 blocks of many contents in step, one numpy lane for each content.

In every step each lane decodes one token. A code is kept as the ends of its
code spaces by length, so a token's length is the number of ends that lie at or
below the next bits, and no large tables are built. When few lanes are left
the rest is decoded one content at a time. Its memory grows with the contents
taken together and it isn't faster than one by one any more, so that nothing
else uses it.
"""

from __future__ import annotations

import numpy as np

from stowage.codec import deflate, lz77
from stowage.codec.bits import CodecError
from stowage.codec.levels import DEFLATE, block_size, check_level
from stowage.codec.trees import LIMIT, valid

#: With fewer lanes a step costs more than it decodes.
FEWEST = 12
_PAD = 16
U = np.uint64


class _Code:
    """Rows of canonical codes, one per lane: ends of the code spaces by length, and symbols in the order of codes."""

    def __init__(self, lanes: int, symbols: int) -> None:
        self.ends = np.zeros((lanes, LIMIT), np.int32)
        self.shift = np.zeros((lanes, LIMIT), np.int32)  # place of a length's first symbol, less that length's first code
        self.symbols = np.zeros((lanes, symbols), np.int16)

    def set(self, lane: int, lengths: np.ndarray) -> None:
        if not valid(lengths):
            raise CodecError("code lengths don't make a full code")
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        counts = np.bincount(lengths[order], minlength=LIMIT + 1)[1:]
        sizes = np.arange(LIMIT - 1, -1, -1)
        ends = np.cumsum(counts << sizes)
        self.ends[lane] = ends
        self.shift[lane] = (np.cumsum(counts) - counts) - ((ends - (counts << sizes)) >> sizes)
        self.symbols[lane, : len(order)] = order

    def read(self, rows: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, length, whether there is one) of the code that each 15-bit number begins with."""
        ends = self.ends[rows]
        past = (ends <= ahead[:, None]).sum(1)
        fine = past < LIMIT
        past = np.minimum(past, LIMIT - 1)
        place = (ahead >> (LIMIT - 1 - past)) + self.shift[rows, past]
        return self.symbols[rows, np.where(fine, place, 0)].astype(np.int64), past + 1, fine


def _bits(words: np.ndarray, skip: np.ndarray, count) -> np.ndarray:
    """``count`` bits of each word behind the first ``skip``."""
    return ((words << skip.astype(U)) >> U(1) >> (U(63) - np.asarray(count).astype(U))).astype(np.int64)


class _Run:
    def __init__(self, contents: list[bytes], level: int) -> None:
        self.contents, self.size = contents, block_size(DEFLATE, level)
        self.level = level
        lengths = np.array([len(c) + _PAD for c in contents], np.int64)
        self.base = np.cumsum(lengths) - lengths
        self.raw = np.frombuffer(b"".join(c + bytes(_PAD) for c in contents), np.uint8)
        self.stop = 8 * (self.base + lengths - _PAD)
        self.at = np.zeros(len(contents), np.int64)  # bits
        self.block = np.zeros(len(contents), np.int64)  # number of the block that a lane is in
        self.made = np.zeros(len(contents), np.int64)  # bytes that it has given
        self.starts: list[tuple[int, int]] = []  # lane and first byte of each block
        self.litlen, self.dist = _Code(len(contents), deflate.LITLEN), _Code(len(contents), deflate.DIST)
        self.errors: dict[int, str] = {}

    def begin(self, lane: int, byte: int) -> bool:
        """Reads the head of the block at ``byte`` of a content; False at its end or on an error."""
        if byte >= len(self.contents[lane]):
            return False
        try:
            bit, lengths, dist_lengths = deflate.head(self.contents[lane], byte)
            self.litlen.set(lane, lengths)
            self.dist.set(lane, dist_lengths)
        except CodecError as e:
            self.errors[lane] = str(e)
            return False
        self.block[lane], self.made[lane] = len(self.starts), 0
        self.starts.append((lane, byte))
        self.at[lane] = 8 * self.base[lane] + bit
        return True

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
        """(block, literal or length, distance) of all tokens, and for contents that aren't decoded to their end the byte where the rest begins."""
        active = np.array([i for i in range(len(self.contents)) if self.begin(i, 0)], np.int64)
        blocks, values, distances = [], [], []
        eight = np.arange(8)
        while len(active) >= FEWEST:
            at = self.at[active]
            words = self.raw[(at >> 3)[:, None] + eight].view(">u8").ravel().astype(U)
            skip = at & 7
            symbol, used, fine = self.litlen.read(active, _bits(words, skip, LIMIT))
            skip = skip + used
            match = symbol > deflate.END
            s = np.where(match, symbol - 257, 0)
            extra = np.where(match, lz77.LENGTH_EXTRA[s], 0)
            value = np.where(match, lz77.LENGTH_BASE[s] + _bits(words, skip, extra), symbol)
            skip = skip + extra
            d, used, near = self.dist.read(active, _bits(words, skip, LIMIT))
            d = np.where(match & near, d, 0)
            skip = skip + np.where(match, used, 0)
            extra = np.where(match, lz77.DISTANCE_EXTRA[d], 0)
            distance = np.where(match, lz77.DISTANCE_BASE[d] + _bits(words, skip, extra), 0)
            skip = skip + extra
            at = at + skip - (at & 7)
            self.at[active] = at
            ended = symbol == deflate.END
            made = self.made[active] + np.where(ended, 0, np.where(match, value, 1))
            self.made[active] = made
            bad = ~fine | match & ~near
            short, large = at > self.stop[active], made > self.size
            odd = ended | bad | short | large
            keep = ~odd
            blocks.append(self.block[active[keep]])
            values.append(value[keep])
            distances.append(distance[keep])
            if odd.any():
                goes = np.zeros(len(active), bool)
                for i in np.flatnonzero(odd).tolist():
                    lane = int(active[i])
                    if bad[i] or short[i] or large[i]:
                        self.errors[lane] = "unexpected end of data" if short[i] else "invalid code" if bad[i] else "more data than a block holds"
                        goes[i] = True
                    else:
                        goes[i] = not self.begin(lane, int((at[i] + 7) // 8 - self.base[lane]))
                active = active[~goes]
        rest = {int(i): self.starts[self.block[i]][1] for i in active}
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *blocks]), np.concatenate([none, *values]), np.concatenate([none, *distances]), rest


def decode_many(contents: list[bytes], level: int) -> list[tuple[bytes | None, str | None]]:
    """(content, error) for each of some encoded contents of one level."""
    check_level(DEFLATE, level)
    run = _Run(contents, level)
    blocks, values, distances, rest = run.run()
    order = np.argsort(blocks, kind="stable")
    values, distances = values[order], distances[order]
    edges = np.searchsorted(blocks[order], np.arange(len(run.starts) + 1))
    out: list[list[bytes]] = [[] for _ in contents]
    for number, (lane, byte) in enumerate(run.starts):
        if lane in run.errors or rest.get(lane) == byte:
            continue
        span = slice(edges[number], edges[number + 1])
        try:
            out[lane].append(deflate.joined(values[span], distances[span]))
        except CodecError as e:
            run.errors[lane] = str(e)
    for lane, byte in rest.items():
        try:
            while lane not in run.errors and byte < len(contents[lane]):
                part, byte = deflate.decode(contents[lane], byte, run.size)
                out[lane].append(part)
        except CodecError as e:
            run.errors[lane] = str(e)
    return [(None, run.errors[i]) if i in run.errors else (b"".join(parts), None) for i, parts in enumerate(out)]
