"""Coding contents that come in pieces of any size: what a piece completes is given at once, the rest is kept for the next."""

from __future__ import annotations

from stowage.codec import NONE, block_size, decode_block, encode_block
from stowage.codec.bits import CodecError

#: A block takes no more than this beyond twice its plain size.
_SLACK = 4096


class Encoder:
    """``feed(data)`` gives the blocks that are full; ``finish()`` the last one. All of them are ``encode_content`` of the whole."""

    def __init__(self, method: int, level: int) -> None:
        self.method, self.level, self.size = method, level, block_size(method, level)
        self.held = bytearray()

    def feed(self, data: bytes) -> bytes:
        self.held += data
        out = []
        while len(self.held) >= self.size:
            out.append(encode_block(bytes(self.held[: self.size]), self.method, self.level))
            del self.held[: self.size]
        return b"".join(out)

    def finish(self) -> bytes:
        out = encode_block(bytes(self.held), self.method, self.level)
        self.held.clear()
        return out


class Decoder:
    """``feed(data)`` gives the content of the blocks that are complete; ``finish()`` fails if one isn't."""

    def __init__(self, method: int, level: int) -> None:
        self.method, self.level, self.size = method, level, block_size(method, level)
        self.held = bytearray()
        self.tried = 0

    def feed(self, data: bytes) -> bytes:
        self.held += data
        if self.method == NONE:
            out = bytes(self.held)
            self.held.clear()
            return out
        if len(self.held) - self.tried < self.size // 16 and self.tried:
            return b""
        return self._blocks(False)

    def _blocks(self, last: bool) -> bytes:
        out, at, data = [], 0, bytes(self.held)
        while at < len(data):
            try:
                block, at = decode_block(data, at, self.method, self.level)
            except CodecError:
                # what looks malformed may only be cut, until there is more than any block takes
                if last or len(data) - at > 2 * self.size + _SLACK:
                    raise
                break
            out.append(block)
        del self.held[:at]
        self.tried = len(self.held)
        return b"".join(out)

    def finish(self) -> bytes:
        return self._blocks(True)
