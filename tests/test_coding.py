"""Codecs in step, in pieces and over other alphabets; token tables; sinks; functions of SQL."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage import codec
from stowage.archive import Archive
from stowage.codec import CodecError, lanes, levels
from stowage.codec.alphabet import Alphabet
from stowage.codec.stream import Decoder, Encoder
from stowage.functions import columns as c
from stowage.functions import udfs
from stowage.operators import coding, tokens


def contents(seed, n=40):
    rng = random.Random(seed)
    out = [b"", b"a", b"ab" * 5000, rng.randbytes(20_000), bytes(9000)]
    while len(out) < n:
        out.append(b"".join(rng.choice([b"some words ", b"and more", rng.randbytes(rng.randrange(9)), b"\n"]) for _ in range(rng.choice([1, 20, 400, 4000]))))
    return out


@pytest.mark.parametrize("level", [0, 3, 8])
@pytest.mark.parametrize("fewest", [1, 12, 1000])
def test_lanes_decode_what_was_encoded(monkeypatch, level, fewest):
    monkeypatch.setattr(lanes, "FEWEST", fewest)
    plain = contents(level)
    coded = [codec.encode_content(x, codec.DEFLATE, level) for x in plain]
    assert codec.decode_contents([(x, codec.DEFLATE, level) for x in coded]) == [(x, None) for x in plain]


def test_lanes_fail_where_one_content_alone_does():
    rng = random.Random(9)
    coded = [codec.encode_content(x, codec.DEFLATE, 1) for x in contents(4, 60)]
    hurt = []
    for x in coded:
        bad = bytearray(x)
        if bad and rng.random() < 0.8:
            if rng.random() < 0.3:
                del bad[rng.randrange(len(bad)) :]
            else:
                bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        hurt.append(bytes(bad))
    got = lanes.decode_many(hurt, 1)
    for x, (data, error) in zip(hurt, got, strict=True):
        try:
            assert (data, error) == (codec.decode_content(x, codec.DEFLATE, 1), None)
        except CodecError:
            assert data is None and error
    assert sum(e is not None for _, e in got) > 20


def test_kinds_are_kept_apart():
    items = [(b"x", 0, 0), (None, 2, 8), (codec.encode_content(b"abc", 1, 2), 1, 2), (b"", 2, 9), (codec.encode_content(b"abc", 2, 4), 2, 4), (b"\xff", 2, 4)]
    got = codec.decode_contents(items)
    assert [x for x, _ in got] == [b"x", None, b"abc", None, b"abc", None]
    assert [bool(e) for _, e in got] == [False, False, False, True, False, True]


@pytest.mark.parametrize("method, level", [(0, 0), (1, 1), (1, 8), (2, 0), (2, 5)])
def test_pieces_of_any_size(method, level):
    rng = random.Random(level)
    for data in (b"", contents(1)[7] * 3, rng.randbytes(40_000)):
        encoder, coded, at = Encoder(method, level), b"", 0
        while at < len(data):
            step = rng.choice([1, 700, 30_000])
            coded += encoder.feed(data[at : at + step])
            at += step
        coded += encoder.finish()
        assert coded == codec.encode_content(data, method, level)
        decoder, plain, at = Decoder(method, level), b"", 0
        while at < len(coded):
            step = rng.choice([50, 3000, 9000])
            plain += decoder.feed(coded[at : at + step])
            at += step
        assert plain + decoder.finish() == data
    if method:
        cut = Decoder(method, level)
        cut.feed(coded[:-5])
        with pytest.raises(CodecError):
            cut.finish()


def test_alphabets_of_any_symbols():
    for symbols in (["red", "green", "blue"], [(x, y) for x in range(20) for y in range(20)], ["one"]):
        rng = random.Random(1)
        message = [rng.choice(symbols) if rng.random() < 0.5 else symbols[0] for _ in range(500)]
        own = Alphabet.of(symbols)
        lengths = own.lengths(message)
        coded = own.encode(message, lengths)
        assert own.decode(coded, len(message), lengths) == message
        assert 8 * len(coded) <= sum(lengths[own.index(s)] for s in message) + 7
    with pytest.raises(CodecError):
        Alphabet.of("ab").encode("b", np.array([1, 0]))


def test_methods_can_be_added():
    import zlib

    own = codec.Codec(lambda raw, level, final: len(x := zlib.compress(raw, level)).to_bytes(4, "big") + x, lambda data, at, size: (zlib.decompress(data[at + 4 : (end := at + 4 + int.from_bytes(data[at : at + 4], "big"))]), end))
    codec.register(77, "zlib", own, (1000, 2000), least=1)
    try:
        assert codec.decode_content(codec.encode_content(b"abc" * 3000, 77, 1), 77, 1) == b"abc" * 3000
        with pytest.raises(CodecError):
            codec.encode_content(b"x", 77, 0)
        with pytest.raises(CodecError):
            codec.register(2, "other", own, (1,))
    finally:
        codec.unregister(77)
    with pytest.raises(CodecError):
        codec.encode_content(b"x", 77, 1)
    with pytest.raises(CodecError):
        codec.unregister(codec.DEFLATE)
    assert len(levels.table()) == 18


def test_tokens_rebuild_contents(spark):
    plain = [x for x in contents(2, 12) if len(x) < 60_000]
    df = spark.createDataFrame([*enumerate(plain), (99, None)], "id long, content binary")
    rows = tokens.symbols(tokens.tokens(df, "id", "content", 2)).orderBy("id", "block_no", "token_no").collect()
    out = {i: [bytearray()] for i in range(len(plain))}
    for r in rows:
        blocks = out[r.id]
        while len(blocks) <= r.block_no:
            blocks.append(bytearray())
        if r.literal is not None:
            blocks[-1].append(r.literal)
            assert r.symbol == r.literal and r.dist_symbol is None
        else:
            for _ in range(r.length):
                blocks[-1].append(blocks[-1][-r.distance])
            assert r.symbol > 256 and r.dist_symbol <= 29
    assert {i: b"".join(b) for i, b in out.items()} == dict(enumerate(plain))
    counts = {(r.id, r.alphabet, r.symbol): r["count"] for r in tokens.symbol_histogram(tokens.tokens(df, "id", "content", 2), "id").collect()}
    want = Counter((r.id, "litlen", r.symbol) for r in rows) + Counter((r.id, "dist", r.dist_symbol) for r in rows if r.dist_symbol is not None)
    want += Counter((i, "litlen", 256) for i, b in out.items() for _ in b if plain[i])
    assert counts == dict(want)


def test_entries_go_to_any_sink(spark, tmp_path):
    class Listing:
        """A sink that writes a line for each entry to a file of its own."""

        def __init__(self, folder):
            import uuid

            self.file = open(os.path.join(folder, uuid.uuid4().hex), "w")  # noqa: SIM115

        def entry(self, path, entry_type, permissions, content):
            if path == "bad":
                raise ValueError("not wanted")
            self.file.write(f"{path} {entry_type} {permissions} {len(content or b'')}\n")

        def link(self, path, target):
            self.file.write(f"{path} -> {target}\n")

        def close(self):
            self.file.close()

    a = Archive(spark, str(tmp_path / "a"))
    rows = [(0, "d/", 2, 0o755, None), (1, "d/x", 1, 0o600, b"12345"), (2, "l", 3, 0o777, b"d/x\0"), (3, "bad", 1, 0, b""), (4, "empty", 3, 0, b"")]
    a.append(spark.createDataFrame(rows, "req long, path string, entry_type int, permissions int, content binary"))
    folder = str(tmp_path / "lists")
    os.mkdir(folder)
    status = {r.path: r.error for r in a.deliver(lambda: Listing(folder)).collect()}
    assert {p for p, e in status.items() if e} == {"bad", "empty"}
    lines = sorted(line for f in os.listdir(folder) for line in open(os.path.join(folder, f)).read().splitlines())
    assert lines == ["d/ 2 493 0", "d/x 1 384 5", "l -> d/x"]


def test_functions_of_sql(spark, tmp_path):
    udfs.register(spark)
    paths = [("d",), ("d/",), ("d/a",), ("dx",), ("",), ("/abs",)]
    spark.createDataFrame(paths, "path string").createOrReplaceTempView("paths")
    for directory in ("d", "d/", ""):
        want = {r.path for r in spark.table("paths").where(c.within_dir("path", directory)).collect()}
        assert {r.path for r in spark.sql("select path from paths where within_dir(path, :d)", {"d": directory}).collect()} == want
    row = spark.sql("select mode_string(2, 493) as m, header_size('abc') as n").first()
    assert (row.m, row.n) == ("drwxr-xr-x", 21)
    a = Archive(spark, str(tmp_path / "a"))
    a.append(spark.createDataFrame([(0, "x", 1, 0o644, b"1"), (1, "y", 1, 0o644, b"2")], "req long, path string, entry_type int, permissions int, content binary"))
    assert [r.path for r in spark.sql(f"select * from archive_entries('{tmp_path}/a') order by ord").collect()] == ["x", "y"]
    shown = spark.range(1).select(c.compression_string(F.lit(2), F.lit(8)).alias("m"), c.entry_type_string(F.lit(3)).alias("t"), c.version_string(F.lit(1025)).alias("v")).first()
    assert tuple(shown) == ("deflate/8", "symlink", "0.1.1")


def test_kraft_inside_rows(spark):
    rows = [([1, 2, 2],), ([0, 0],), ([0, 5],), ([1, 1, 1],), ([15] * 2 + list(range(14, 0, -1)),)]
    got = [tuple(r.k) for r in spark.createDataFrame(rows, "lens array<int>").select(coding.kraft_of("lens").alias("k")).collect()]
    assert got == [(32768, 3, True), (0, 0, True), (1024, 1, True), (49152, 3, False), (32768, 16, True)]
