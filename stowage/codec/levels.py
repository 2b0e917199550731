"""Methods, levels and what they set. Fixed values of the archive format."""

from __future__ import annotations

from stowage.codec.bits import CodecError

NONE, HUFFMAN, DEFLATE = 0, 1, 2
METHODS = {"none": NONE, "huffman": HUFFMAN, "deflate": DEFLATE}
NAMES = {number: name for name, number in METHODS.items()}
LEVELS = {NONE: (0, 0), HUFFMAN: (1, 8), DEFLATE: (0, 8)}

K = 1024
HUFFMAN_BLOCKS = (4 * K, 4 * K, 8 * K, 16 * K, 24 * K, 32 * K, 48 * K, 64 * K, 128 * K)
DEFLATE_BLOCKS = (8 * K, 16 * K, 16 * K, 24 * K, 24 * K, 32 * K, 32 * K, 64 * K, 64 * K)
STORED_BLOCK = 64 * K
#: A match this long is taken without looking at the next position.
LAZY_THRESHOLDS = (0, 32, 64, 96, 128, 160, 192, 224, 256)
#: Matches up to this long have all their places noted for later matches. Kept for the format's level table; here all places are.
INSERT_THRESHOLDS = (1, 5, 6, 7, 8, 9, 10, 11, 12)


def check_level(method: int, level: int) -> None:
    if method not in LEVELS:
        raise CodecError(f"unknown compression method {method}")
    least, most = LEVELS[method]
    if not least <= level <= most:
        raise CodecError(f"compression level {level} is out of range {least} to {most}")


BLOCKS = {NONE: (STORED_BLOCK,), HUFFMAN: HUFFMAN_BLOCKS, DEFLATE: DEFLATE_BLOCKS}


def block_size(method: int, level: int) -> int:
    check_level(method, level)
    sizes = BLOCKS[method]
    return sizes[min(level, len(sizes) - 1)]


def table() -> list[tuple[int, int, int, int | None, int | None]]:
    """(method, level, block bytes, lazy threshold, insert threshold) of every level; thresholds are Deflate's."""
    out = []
    for method, (least, most) in sorted(LEVELS.items()):
        for level in range(least, most + 1):
            deflate = method == DEFLATE
            out.append((method, level, block_size(method, level), LAZY_THRESHOLDS[level] if deflate else None, INSERT_THRESHOLDS[level] if deflate else None))
    return out
