"""Blocks coded together, memory of decoding, stored contents without Python, totals of tokens."""

import random
import tracemalloc

import numpy as np
import pytest

from stowage import codec
from stowage.codec import lz77
from stowage.operators import blocks, tokens


def contents(seed, n):
    rng = random.Random(seed)
    out = [b"", b"a", b"abc", b"ab" * 5000, rng.randbytes(20_000), bytes(9000), bytes(range(256)) * 64]
    while len(out) < n:
        out.append(b"".join(rng.choice([b"some words ", b"and more", rng.randbytes(rng.randrange(9)), b"\n"]) for _ in range(rng.choice([1, 20, 400, 4000]))))
    return out


@pytest.mark.parametrize("method, level", [(1, 1), (1, 5), (1, 8), (2, 0), (2, 1), (2, 4), (2, 8)])
def test_blocks_together_are_those_one_by_one(method, level):
    raws = [b for x in contents(level, 40) for b in codec.split(x, method, level)] + [b""]
    made = codec.encode_blocks(raws, method, level)
    assert made == [codec.encode_block(r, method, level) for r in raws]
    whole = contents(level, 40)
    assert codec.decode_contents([(x, method, level) for x in codec.encode_contents(whole, method, level)]) == [(x, None) for x in whole]


@pytest.mark.parametrize("level", [0, 8])
def test_decoding_takes_little_beside_the_contents(level):
    one = codec.encode_content(contents(3, 9)[8] * 2, codec.DEFLATE, level)
    tracemalloc.start()
    plain = codec.decode_contents([(one, codec.DEFLATE, level)] * 300)
    size, peak = sum(len(x) for x, _ in plain), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * size + (4 << 20)


def test_stored_contents_need_no_python(spark, capsys):
    df = spark.createDataFrame([(0, b"x" * 70_000), (1, b""), (2, None)], "id long, content binary")
    made = blocks.encode_contents(df, "id", "content", codec.NONE, 0).selectExpr("id", "payload", "0 as method", "0 as level")
    again = blocks.decode_contents(made)
    again.explain()
    assert "ArrowEvalPython" not in capsys.readouterr().out
    assert sorted((r.id, r.content and bytes(r.content), r.error) for r in again.collect()) == [(0, b"x" * 70_000, None), (1, b"", None), (2, None, None)]


def test_totals_are_those_of_the_tokens(spark):
    rows = [(i, x) for i, x in enumerate([*contents(2, 20), None])]
    df = spark.createDataFrame(rows, "id long, content binary")
    want = {}
    for i, x in rows:
        if parts := codec.split(x or b"", codec.DEFLATE, 1):
            made = [lz77.tokens(p, 1) for p in parts]
            want[i] = (len(parts), sum(len(v) for v, _ in made), sum(int(np.where(d > 0, v, 1).sum()) for v, d in made))
    assert {r.id: (r.blocks, r.tokens, r.bytes) for r in tokens.totals(df, "id", "content", 1).collect()} == want
    assert all(want[i][2] == len(x) for i, x in rows if x)
