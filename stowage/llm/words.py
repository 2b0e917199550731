"""Words, word n-grams and sets of them as 64-bit hashes, many texts at a time in numpy.

The texts of a batch lie in one byte buffer, which is gone over in slices of
``SLICE_BYTES``. A running sum of byte values times powers of an odd base,
modulo 2**64, gives each word's sum by one subtraction, so no Python code runs
per word. Sums of the parts of a word that a slice's end cuts are put together,
so memory beside the texts is a few bytes per word, however long a text is.
Such sums have built-in collisions between long words; words of more than
``LONG_WORD`` bytes are hashed by BLAKE2 instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
SPACES = b" \t\n\v\f\r"
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20
SLICE_BYTES = 1 << 17
LONG_WORD = 256
#: Text that is turned into Python objects at once, unless one text is longer.
BATCH_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(1, U)
    while len(out) < n:
        step = U(pow(base, len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    return out[:n]


UP, DOWN = powers(_BASE, SLICE_BYTES), powers(_INVERSE, SLICE_BYTES)
VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_LOWER = VALUES.copy()
_LOWER[65:91] = VALUES[97:123]
#: Kinds of bytes: 0 parts tokens, and a token is a run of one other kind.
BY_SPACES = np.ones(256, np.int8)
BY_SPACES[list(SPACES)] = 0
BY_MARKS = BY_SPACES.copy()
BY_MARKS[[i for i in range(128) if BY_SPACES[i] and not chr(i).isalnum()]] = 2
ONLY_WORDS = BY_MARKS % 2


def rows_by_bytes(batches: Iterable[pa.RecordBatch], column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``batches`` cut into runs of rows with about ``limit`` bytes in a string or binary column; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES):
    """Slices of ``texts`` of about ``limit`` bytes each; a longer text stands alone, whole."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of some texts: ``hashes``, and per text the range ``first[i]:first[i+1]``. ``raw`` holds the texts parted by spaces."""

    def __init__(self, texts: list[bytes], lower: bool = True, kinds: np.ndarray = BY_SPACES) -> None:
        self.raw = b" ".join([b"", *texts, b""]) if texts else b" "
        offsets = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)]).astype(np.int64)
        self.first = np.zeros(len(offsets), np.int64)
        values = _LOWER if lower else VALUES
        made, n_words, reached = [], 0, 0
        held = None  # the part of a word before the slice: where it begins, its sum, its kind
        for base in range(0, len(self.raw), SLICE_BYTES):
            part = np.frombuffer(self.raw, np.uint8, min(SLICE_BYTES, len(self.raw) - base), base)
            n = len(part)
            kind = kinds[part]
            bounds = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [n]])
            runs = np.flatnonzero(kind[bounds[:-1]] > 0)
            starts, ends = bounds[runs], bounds[runs + 1]
            total = np.zeros(n + 1, U)
            np.cumsum(values[part] * UP[:n], out=total[1:])
            sums = (total[ends] - total[starts]) * DOWN[starts]
            begins = starts + base
            if held is not None:
                at, value, was = held
                if kind[0] == was:
                    begins[0] = at
                    sums[:1] = value + sums[:1] * U(pow(_BASE, base - at, 1 << 64))
                else:
                    begins, sums, ends = np.insert(begins, 0, at), np.concatenate([value, sums]), np.insert(ends, 0, 0)
                held = None
            if kind[-1] > 0:
                held = int(begins[-1]), sums[-1:].copy(), kind[-1]
                begins, sums, ends = begins[:-1], sums[:-1], ends[:-1]
            lengths = ends + base - begins
            hashes = mix(sums + lengths.astype(U))
            for i in np.flatnonzero(lengths > LONG_WORD):
                hashes[i] = _long_hash(self.raw[begins[i] : begins[i] + lengths[i]], lower)
            made.append(hashes)
            upto = int(np.searchsorted(offsets, base + n, "right"))
            self.first[reached:upto] = n_words + np.searchsorted(begins, offsets[reached:upto])
            n_words, reached = n_words + len(hashes), upto
        self.first[reached:] = n_words
        self.hashes = np.concatenate(made)

    def ngrams(self, k: int) -> np.ndarray:
        """A hash for the k words from each word on; the caller leaves out those that pass a text's end."""
        w = self.hashes
        out = np.zeros(len(w), U)
        if len(w) >= k:
            m = len(w) - k + 1
            for j in range(k):
                out[:m] += w[j : j + m] * U(pow(_BASE, 2 * j + 1, 1 << 64))
        return mix(out)


_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _long_hash(word: bytes, lower: bool) -> np.uint64:
    made = hashlib.blake2b(word.translate(_TO_LOWER) if lower else word, digest_size=8).digest()
    return U(int.from_bytes(made, "little"))


def sequence_hash(words: np.ndarray) -> np.uint64:
    """The hash of a text's whole word sequence, as ``ngrams`` gives it for that length."""
    steps = np.array([pow(_BASE, 2 * j + 1, 1 << 64) for j in range(len(words))], U)
    return mix(np.array([np.sum(words * steps, dtype=U)], U) + U(0))[0]


def shingle_sets(texts: list[bytes], k: int):
    """For each text the sorted distinct hashes of its k-word shingles.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    for a, b in chunks(texts):
        found = Words(texts[a:b])
        grams = found.ngrams(k)
        for i in range(b - a):
            lo, hi = found.first[i], found.first[i + 1]
            if hi - lo >= k:
                yield np.unique(grams[lo : hi - k + 1])
            elif hi > lo:
                yield np.array([sequence_hash(found.hashes[lo:hi]) ^ U(hi - lo)], U)
            else:
                yield np.zeros(0, U)
