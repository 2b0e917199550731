"""Bit streams, most significant bit first."""

from __future__ import annotations

import numpy as np


class CodecError(ValueError):
    """A malformed stream, or parameters out of range."""


def pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    """The low ``widths[i]`` bits of each value, one after another, padded with zeros to a byte."""
    widths = widths.astype(np.int64)
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    below = np.repeat(ends, widths) - np.arange(total) - 1  # bits that follow in the same value
    return np.packbits((np.repeat(values.astype(np.uint32), widths) >> below.astype(np.uint32) & 1).astype(np.uint8)).tobytes()


class Fields:
    """Values and widths gathered for one call of ``pack``."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.widths: list[np.ndarray] = []

    def add(self, values, widths) -> None:
        self.values.append(np.atleast_1d(np.asarray(values, np.int64)))
        self.widths.append(np.atleast_1d(np.asarray(widths, np.int64)))

    def bytes(self) -> bytes:
        return pack(np.concatenate(self.values), np.concatenate(self.widths))


class Reader:
    """Reads a few bits at a time from ``data``, starting at a byte."""

    def __init__(self, data: bytes, byte: int) -> None:
        self.data, self.at = data, 8 * byte

    def read(self, n: int) -> int:
        first, end = self.at >> 3, (self.at + n + 7) >> 3
        if self.at + n > 8 * len(self.data):
            raise CodecError("unexpected end of data")
        value = int.from_bytes(self.data[first:end], "big") >> (8 * end - self.at - n) & ((1 << n) - 1)
        self.at += n
        return value

    def ahead(self, n: int) -> int:
        """The next ``n`` bits as a number without taking them, zeros following the end."""
        first, wide = self.at >> 3, n + 14 >> 3
        part = self.data[first : first + wide].ljust(wide, b"\0")
        return int.from_bytes(part, "big") >> (8 * wide - (self.at & 7) - n) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        if self.at + n > 8 * len(self.data):
            raise CodecError("unexpected end of data")
        self.at += n


def windows(data: bytes) -> np.ndarray:
    """The 16 bits from each bit position of ``data`` on, zeros following its end."""
    padded = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    wide = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    shifts = np.arange(8, 0, -1, dtype=np.uint32)
    return (wide[:, None] >> shifts & 0xFFFF).ravel()


#: Bits that ``words`` gives from any bit position on.
WORD = 49


def words(data: bytes) -> list[int]:
    """56 bits from each byte of ``data`` on, zeros following its end."""
    padded = np.frombuffer(data + bytes(7), np.uint8).astype(np.int64)
    n, out = len(data) + 1, np.zeros(len(data) + 1, np.int64)
    for i in range(7):
        out |= padded[i : i + n] << (48 - 8 * i)
    return out.tolist()
