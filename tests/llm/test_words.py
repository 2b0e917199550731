import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from stowage.llm import words
from stowage.llm.words import BY_MARKS, BY_SPACES, ONLY_WORDS, Words, rows_by_bytes


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("kinds", [BY_SPACES, BY_MARKS, ONLY_WORDS])
def test_slices_give_the_words_of_the_whole(monkeypatch, kinds):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab ,.\n") for _ in range(rng.randrange(60))).encode() for _ in range(80)] + [b"", b"x" * 900, b"y" * 700 + b" z"]
    whole = Words(texts, kinds=kinds)
    brute = []
    for t in texts:
        runs, last = [], 0
        for i, b in enumerate(t):
            if kinds[b] and (i == 0 or kinds[b] != last):
                runs.append(bytes([b]))
            elif kinds[b]:
                runs[-1] += bytes([b])
            last = kinds[b]
        brute.append(runs)
    assert np.diff(whole.first).tolist() == [len(r) for r in brute]
    numbers = {}
    for run, h in zip([r for rs in brute for r in rs], whole.hashes.tolist(), strict=True):
        assert numbers.setdefault(run, h) == h
    assert len(set(numbers.values())) == len(numbers)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(words, "SLICE_BYTES", size)
        cut = Words(texts, kinds=kinds)
        assert (cut.hashes == whole.hashes).all() and (cut.first == whole.first).all()


def test_long_words_have_no_built_in_collisions():
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    a, b = Words([one.encode(), other.encode()]).hashes
    assert a != b
    assert Words([one.upper().encode()]).hashes[0] == a == int.from_bytes(hashlib.blake2b(one.encode(), digest_size=8).digest(), "little")


def test_batches_are_cut_by_bytes():
    texts = ["x" * n for n in (5, 0, 7, 100, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["i", "t"])
    parts = list(rows_by_bytes([batch, batch.slice(0, 0)], 1, 12))
    assert [p.num_rows for p in parts] == [3, 1, 4]
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
