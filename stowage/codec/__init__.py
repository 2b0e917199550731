"""Block codecs: store, byte Huffman, and LZ77 with dynamic Huffman. Plain functions on bytes, in numpy.

``encode_block`` and ``decode_content`` choose by method. Streams are most
significant bit first; blocks are padded to bytes and follow each other
without an index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

from stowage.codec import deflate, huffman, levels, many
from stowage.codec.bits import CodecError
from stowage.codec.levels import DEFLATE, HUFFMAN, METHODS, NONE, block_size, check_level

__all__ = ["Codec", "CodecError", "DEFLATE", "HUFFMAN", "METHODS", "NONE", "block_size", "check_level", "decode_content", "decode_contents", "decode_block", "encode_block", "encode_blocks", "encode_content", "encode_contents", "register", "split", "unregister"]


@dataclass(frozen=True)
class Codec:
    """How the blocks of a method are coded: ``encode(raw, level, final)``, and ``decode(data, byte, size)`` to (content, next byte).

    ``many(raws, level, finals)``, where there is one, encodes several blocks together.
    """

    encode: Callable[[bytes, int, bool], bytes]
    decode: Callable[[bytes, int, int], tuple[bytes, int]]
    many: Callable[[list[bytes], int, list[bool]], list[bytes]] | None = None


CODECS: dict[int, Codec] = {HUFFMAN: Codec(huffman.encode, huffman.decode, many.encode_huffman), DEFLATE: Codec(deflate.encode, deflate.decode, many.encode_deflate)}
#: Bytes and blocks that are encoded together at most: what memory they take doesn't grow with a batch. Larger blocks go alone.
GROUP_BYTES, GROUP_BLOCKS = 128 << 10, 256


def register(number: int, name: str, codec: Codec, blocks: tuple[int, ...], least: int = 0) -> None:
    """Adds a method with its levels from ``least`` on and a block size for each level from 0; in every process that codes with it."""
    if not 0 <= number <= 255 or number in METHODS.values() or name in METHODS or not least < len(blocks):
        raise CodecError(f"method {number} or its name {name!r} is taken or out of range")
    METHODS[name], levels.NAMES[number] = number, name
    levels.LEVELS[number], levels.BLOCKS[number] = (least, len(blocks) - 1), blocks
    CODECS[number] = codec


def unregister(number: int) -> None:
    if number in (NONE, HUFFMAN, DEFLATE):
        raise CodecError("a method of the format itself")
    METHODS.pop(levels.NAMES.pop(number))
    del levels.LEVELS[number], levels.BLOCKS[number], CODECS[number]


def encode_block(raw: bytes, method: int, level: int) -> bytes:
    """One block encoded; it is a final one if shorter than the block size."""
    check_level(method, level)
    if method == NONE or not raw:
        return raw
    size = block_size(method, level)
    if len(raw) > size:
        raise CodecError(f"a block of {len(raw)} bytes, over {size}")
    return CODECS[method].encode(raw, level, len(raw) < size)


def grouped(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first, end) of the blocks to be coded together."""
    first, size = 0, 0
    for i, raw in enumerate(raws):
        if i > first and (size + len(raw) > GROUP_BYTES or i - first == GROUP_BLOCKS):
            yield first, i
            first, size = i, 0
        size += len(raw)
    if first < len(raws):
        yield first, len(raws)


def encode_blocks(raws: list[bytes], method: int, level: int) -> list[bytes]:
    """``encode_block`` of each."""
    check_level(method, level)
    if method == NONE or (together := CODECS[method].many) is None:
        return [encode_block(r, method, level) for r in raws]
    size = block_size(method, level)
    if large := [len(r) for r in raws if len(r) > size]:
        raise CodecError(f"a block of {large[0]} bytes, over {size}")
    full, out = [r for r in raws if r], []
    for first, end in grouped(full):
        part = full[first:end]
        out += together(part, level, [len(r) < size for r in part])
    made = iter(out)
    return [next(made) if r else r for r in raws]


def decode_block(data: bytes, at: int, method: int, level: int) -> tuple[bytes, int]:
    """The content of the block at byte ``at``, and where the next begins."""
    if method == NONE:
        return data[at:], len(data)
    return CODECS[method].decode(data, at, block_size(method, level))


def split(raw: bytes, method: int, level: int) -> list[bytes]:
    size = block_size(method, level)
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def encode_content(raw: bytes, method: int, level: int) -> bytes:
    return encode_contents([raw], method, level)[0]


def encode_contents(raws: list[bytes], method: int, level: int) -> list[bytes]:
    """``encode_content`` of each."""
    blocks = [split(r, method, level) for r in raws]
    made = iter(encode_blocks([b for bs in blocks for b in bs], method, level))
    return [b"".join(islice(made, len(bs))) for bs in blocks]


def decode_contents(items: list[tuple[bytes | None, int, int]]) -> list[tuple[bytes | None, str | None]]:
    """(content, error) of each (data, method, level), one after another. Null data stay null."""
    out: list[tuple[bytes | None, str | None]] = []
    for data, method, level in items:
        try:
            out.append((None if data is None else decode_content(data, method, level), None))
        except CodecError as e:
            out.append((None, str(e)))
    return out


def decode_content(data: bytes, method: int, level: int) -> bytes:
    """The content of encoded blocks; ``CodecError`` if they are malformed."""
    check_level(method, level)
    out, at = [], 0
    while at < len(data):
        block, at = decode_block(data, at, method, level)
        out.append(block)
    return b"".join(out)
