import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stowage.llm import best_fit_packing as b
from stowage.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_tokenizer():
    rng = random.Random(3)
    signs = ["a", "b", " ", " ", " ", "\n", "\t", ".", ",", "'s", "'", "9", "é", "<|endoftext|>", "\r\n", "\xa0", "\x1c", "\x0b", "word", " word", "日本", "🙂", "\u0085", "###", "i̇"]
    texts = ["", " ", "  ", "   ", "\n", " a", "a ", "a\n b", "a \n \n b", "x." * 50] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    encode, plain = Encoder(PATH), Tokenizer.from_file(PATH)
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def brute(lengths, capacity, limit):
    bins, out, made = [], [], 0
    for n in lengths:
        fitting = [x for x in bins if x[1] >= n]
        if fitting:
            chosen = min(fitting, key=lambda x: x[1])
            free = chosen[1]
            same = [x for x in bins if x[1] == free]
            chosen = same[-1]
            bins.remove(chosen)
        else:
            if len(bins) == limit:
                free = min(x[1] for x in bins)
                bins.remove([x for x in bins if x[1] == free][-1])
            chosen = (made, capacity)
            made += 1
        out.append((chosen[0], capacity - chosen[1]))
        if chosen[1] > n:
            bins.append((chosen[0], chosen[1] - n))
    return out


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_best_fit_by_brute_force(limit):
    rng = random.Random(limit)
    lengths = [rng.randint(1, 30) for _ in range(500)]
    packer = b.BestFit(30, limit)
    assert [packer.place(n) for n in lengths] == brute(lengths, 30, limit)
    with pytest.raises(ValueError):
        packer.place(31)


def test_cut():
    assert b.cut(10, 4) == [(0, 2), (2, 4), (6, 4)]
    assert b.cut(8, 4) == [(0, 4), (4, 4)]
    assert b.cut(4, 4) == [(0, 4)] and b.cut(1, 4) == [(0, 1)]


def test_query_rebuilds_every_document(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma,", "\n", "é"]) for _ in range(rng.choice([0, 5, 300, 6000])))) for i in range(60)] + [(None, "no number"), (7, "again"), (7, "again"), (100, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    out = b.op4_best_fit_packing(spark, str(tmp_path)).collect()
    plain = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, (start, n) in enumerate(b.cut(len(ids), 2048)):
            want.append((doc_id, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(want, key=str)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= sum(w[3] for w in want) // 2048 + 2
    assert b.pack_documents(spark.createDataFrame(rows[:0], "doc_id long, text string")).count() == 0


def test_bins_are_closed_and_little_is_lost(spark):
    rng = random.Random(3)
    lengths = [rng.choice([rng.randint(1, 300), rng.randint(300, 2048), 2048]) for _ in range(30_000)]
    rows = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
    found = spark.createDataFrame(rows, b.PIECES).repartition(3)
    out = b.pack(found, len(rows)).toPandas()
    assert len(out) == len(rows)
    bins = out.sort_values("offset").groupby("sequence_id")
    ends = bins["length"].sum()
    assert ends.max() <= b.CAPACITY and (bins["length"].cumsum() - out.sort_values("offset")["length"] == out.sort_values("offset")["offset"]).all()
    least = -(-sum(lengths) // b.CAPACITY)
    assert len(ends) > b.OPEN_BINS and len(ends) <= 1.005 * least


def test_tiktoken_is_used_only_where_it_agrees(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert Encoder(path).quick is not None
    other = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert Encoder(path, other).quick is None
    assert Encoder(path, str(tmp_path / "none")).quick is None
    assert Encoder(path, other)("some text, and more") == Encoder(path)("some text, and more")
