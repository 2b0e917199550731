"""Huffman coding of symbols of any kind, by callables between symbols and their numbers."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence

import numpy as np

from stowage.codec.bits import CodecError, Fields, Reader
from stowage.codec.trees import LIMIT, canonical, code_lengths, lookup


class Alphabet:
    """``index(symbol)`` is its number from 0 to ``size`` - 1, and ``symbol(index)`` the way back."""

    def __init__(self, size: int, index: Callable[[Hashable], int], symbol: Callable[[int], Hashable]) -> None:
        self.size, self.index, self.symbol = size, index, symbol

    @classmethod
    def of(cls, symbols: Sequence[Hashable]) -> Alphabet:
        """The alphabet of the given symbols in their order."""
        places = {s: i for i, s in enumerate(symbols)}
        return cls(len(symbols), places.__getitem__, list(symbols).__getitem__)

    def lengths(self, message: Sequence[Hashable]) -> np.ndarray:
        """Optimal code lengths for a message."""
        return code_lengths(np.bincount([self.index(s) for s in message], minlength=self.size))

    def encode(self, message: Sequence[Hashable], lengths: np.ndarray) -> bytes:
        numbers = np.array([self.index(s) for s in message], np.int64)
        if (np.asarray(lengths)[numbers] == 0).any():
            raise CodecError("a symbol without a code")
        fields = Fields()
        fields.add(canonical(lengths)[numbers], np.asarray(lengths)[numbers])
        return fields.bytes()

    def decode(self, data: bytes, count: int, lengths: np.ndarray) -> list[Hashable]:
        """The first ``count`` symbols."""
        symbols, sizes = lookup(lengths)
        reader, out = Reader(data, 0), []
        for _ in range(count):
            prefix = reader.ahead(LIMIT)
            if not sizes[prefix]:
                raise CodecError("invalid code")
            reader.skip(int(sizes[prefix]))
            out.append(self.symbol(int(symbols[prefix])))
        return out
