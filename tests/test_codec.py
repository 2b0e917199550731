import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stowage import codec
from stowage.codec import CodecError, deflate, huffman, lz77, trees
from stowage.codec.bits import Fields, Reader, pack

PAIRS = [(0, 0)] + [(1, n) for n in range(1, 9)] + [(2, n) for n in range(9)]
WORDS = ["the", "archive", "holds", "entries", "of", "any", "length", "and", "kind", "\n", ", "]


def prose(n, seed=1, noise=16):
    rng = random.Random(seed)
    raw = bytearray(" ".join(rng.choice(WORDS) for _ in range(n // 3 + 1)).encode()[:n])
    for i in range(len(raw)):
        if rng.randrange(256) < noise:
            raw[i] = rng.randrange(256)
    return bytes(raw)


@pytest.mark.parametrize("method, level", PAIRS)
def test_round_trip_at_block_edges(method, level):
    size = codec.block_size(method, level)
    for n in (0, 1, 2, 3, 4, 100, size - 1, size, size + 1, 2 * size):
        for raw in (prose(n, n), b"0" * n):
            data = codec.encode_content(raw, method, level)
            assert codec.decode_content(data, method, level) == raw
            if n > 1000:
                assert len(data) <= len(raw)


@pytest.mark.parametrize("method, level", [(1, 1), (1, 8), (2, 0), (2, 4), (2, 8)])
def test_hard_contents(method, level):
    rng = random.Random(2)
    for raw in (bytes(range(256)) * 40, rng.randbytes(30_000), b"ab" * 50_000, b"\xff", bytes(300_000), b"abc" * 3 + rng.randbytes(40_000) + b"abc" * 3):
        assert codec.decode_content(codec.encode_content(raw, method, level), method, level) == raw


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bcd", b"bcde", b"\x00", b"xyz" * 20, bytes(range(50))]), max_size=300), st.sampled_from(PAIRS))
def test_round_trip_property(parts, pair):
    raw = b"".join(parts)
    assert codec.decode_content(codec.encode_content(raw, *pair), *pair) == raw


def test_composed_by_concatenation():
    size = codec.block_size(2, 0)
    raw = prose(3 * size + 77)
    whole = codec.encode_content(raw, 2, 0)
    assert whole == b"".join(codec.encode_block(raw[i : i + size], 2, 0) for i in range(0, len(raw), size))


@pytest.mark.parametrize("freqs", [[1, 2, 4, 8, 16, 32], [1, 1, 1, 1, 1, 64], [1], [0, 0, 0], [], [5, 0, 0, 7]] + [[random.Random(s).randrange(124) for _ in range(s + 1)] for s in range(0, 300, 17)])
def test_code_lengths_are_valid_and_optimal(freqs):
    lengths = trees.code_lengths(freqs)
    assert trees.valid(lengths)
    assert [n > 0 for n in lengths] == [f > 0 for f in freqs]
    used = sorted(f for f in freqs if f)
    cost, heap = 0, list(used)
    while len(heap) > 1:  # the cost of an unlimited code
        heap.sort()
        heap[:2] = [heap[0] + heap[1]]
        cost += heap[0]
    if len(used) > 1:
        assert int(np.dot(lengths, freqs)) == cost
    codes = trees.canonical(lengths)
    texts = [f"{c:0{n}b}" for c, n in zip(codes, lengths, strict=True) if n]
    assert not any(b.startswith(a) for a, b in itertools.permutations(texts, 2))


def test_limit_is_kept():
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(sum(fibonacci[-2:]))
    for limit in (7, 15):
        lengths = trees.code_lengths(fibonacci, limit)
        assert lengths.max() == limit and trees.valid(lengths, limit)


def test_canonical_recurrence():
    rng = random.Random(4)
    for _ in range(100):
        lengths = trees.code_lengths([rng.randrange(50) for _ in range(rng.randrange(2, 60))])
        order = sorted((int(n), i) for i, n in enumerate(lengths) if n)
        code, before = -1, order[0][0] if order else 0
        for n, i in order:
            code = (code + 1) << (n - before) if code >= 0 else 0
            before = n
            assert trees.canonical(lengths)[i] == code


@pytest.mark.parametrize("lengths", [[15, 15, 15, 15, 13, 12, 12, 12, 12], [0, 0, 0, 1], [0, 0, 0], [1], [0] * 320, [7] * 320, [0] * 10 + [3] * 9 + [0] * 150 + [2, 2]] + [[random.Random(s).randrange(16) for _ in range(s)] for s in range(1, 320, 13)])
def test_length_sections(lengths):
    fields = Fields()
    trees.write_lengths(fields, lengths)
    assert trees.read_lengths(Reader(fields.bytes() + bytes(2), 0), len(lengths)).tolist() == lengths


def test_symbols_cover_all_values():
    lengths, distances = np.arange(3, 259), np.arange(1, 32769)
    s, d = lz77.length_symbol(lengths), lz77.distance_symbol(distances)
    assert (s[0], s[-1], s[-2], d[-1]) == (0, 28, 27, 29)
    assert ((lengths - lz77.LENGTH_BASE[s]) < (1 << lz77.LENGTH_EXTRA[s])).all()
    assert ((distances - lz77.DISTANCE_BASE[d]) < (1 << lz77.DISTANCE_EXTRA[d])).all()


def test_invalid_codes_are_rejected():
    assert not trees.valid([1, 2, 2, 2])
    with pytest.raises(CodecError):
        trees.lookup([1, 2, 2, 2])


def test_bits_come_most_significant_first():
    assert pack(np.array([0b1, 0b0110, 0b101]), np.array([1, 4, 3])) == bytes([0b10110101])
    reader = Reader(bytes([0b10110101, 0xFF]), 0)
    assert [reader.read(n) for n in (1, 4, 3, 8)] == [1, 6, 5, 255]
    with pytest.raises(CodecError):
        reader.read(1)


@pytest.mark.parametrize("method, level", [(1, 3), (2, 8)])
def test_malformed_streams_end_in_errors(method, level):
    rng = random.Random(9)
    data = codec.encode_content(prose(5000), method, level)
    for _ in range(200):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        try:
            codec.decode_content(bytes(bad[: rng.randint(1, len(bad))]), method, level)
        except CodecError:
            pass


def test_rules_of_the_format():
    with pytest.raises(CodecError, match="block type"):
        deflate.decode(bytes([0b00000000] * 40), 0, 8192)
    with pytest.raises(CodecError):
        codec.encode_block(b"x", 1, 0)
    with pytest.raises(CodecError):
        codec.encode_block(b"x", 3, 0)
    with pytest.raises(ValueError):
        lz77.expand([3], [5], [2], b"ab")
    assert lz77.expand([7], [2], [2], b"ab!") == b"ababababa!"
    size = codec.block_size(1, 1)
    assert huffman.decode(huffman.encode(b"a" * size, 1, False), 0, size)[0] == b"a" * size


def test_highest_level_tries_all_places():
    from stowage.codec import lz77

    near = b"".join(b"abc" + bytes([200 + i % 50, 100 + i // 50]) for i in range(300))
    lengths, distances = lz77.tokens(b"abcdefgh" + near + b"abcdefgh", 8)
    assert (lengths[-1], distances[-1]) == (8, 8 + len(near))
