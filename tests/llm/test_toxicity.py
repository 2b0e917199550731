import random
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from stowage.llm import labelled, toxicity

BAD = ["idiot", "stupid", "worthless"]
GOOD = "table chair river mountain paper window garden letter morning silver".split()


def texts(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(GOOD) + rng.choice(["", "s", "ed", "er"]) for _ in range(rng.randint(5, 80))]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


def test_grams_by_brute_force():
    raw = [b"ab cde", b"", b"cde  x", "über".encode()]
    bags = toxicity.Bags(raw)
    words = [w for t in raw for w in t.split()]
    marked = [b" " + w + b" " for w in words]
    want = [1 + sum(max(0, len(m) - n + 1) for n in toxicity.SIZES) for m in marked]
    assert np.bincount(bags.owner).tolist() == want
    sets = [set(bags.grams[bags.owner == i]) for i in range(len(words))]
    assert sets[1] == sets[2]


def test_learns_and_generalises():
    model = toxicity.train([(t.encode(), k) for t, k in texts(600, 1)], rounds=3)
    held = texts(300, 2)
    scores = model.scores([t for t, _ in held])
    assert np.mean((scores >= 0.7) == np.array([k == 1 for _, k in held])) > 0.97
    odd, plain = model.scores(["the stuupid idiiot river", "the silver rivers"])
    assert odd > 0.7 > plain
    assert model.scores([None, ""]).tolist() == model.scores(["", " "]).tolist()
    assert model.scores([" ".join(GOOD * 3000 + ["idiot"])])[0] > 0.7


def test_query(spark, tmp_path):
    rows = [(i, t, "en") for i, (t, _) in enumerate(texts(300, 3))] + [(None, None, None), (5, "repeated id", "x"), (900, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 3 == 0)) for i in range(300)] + [(7, None), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, *_ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    right = [r.predicted == int(r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.doc_id < 300 and r.held_out]
    assert np.mean(right) > 0.9
    model = toxicity.train([])
    assert toxicity.score(docs.limit(0), model).count() == 0
    kept = toxicity.clean(docs, toxicity.train([(t.encode(), k) for t, k in texts(600, 1)], rounds=3))
    assert kept.columns == docs.columns and 150 < kept.count() < 260


def test_sample_is_learned_from_the_right_rows(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    got = labelled.sample(docs, labels, "toxic", rows_per_class=10)
    import zlib

    assert len(got) == 20 and sum(k for _, k in got) == 10
    assert all(zlib.crc32(t) % 3 != 1 and k == int(t) % 2 for t, k in got)
    out = spark.range(60).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in out)


def test_long_texts_score_in_pieces_as_whole():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), 0.5)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 12))) for _ in range(60_000)]
    long = [" ".join(words), "-".join(words), "é" * 300_000 + " x", "Ab " * 100_000]
    for text in long:
        bags = toxicity.Bags([toxicity.fold(text)])
        sums = np.bincount(bags.owner, model.table[bags.grams]) / np.bincount(bags.owner)
        want = 1 / (1 + np.exp(-(toxicity.window_scores(sums).max() + model.bias)))
        assert abs(model.scores([None, text, "x"])[1] - want) < 1e-6


def test_memory_does_not_grow_with_a_text():
    code = """
import resource, numpy as np
from stowage.llm import toxicity
model = toxicity.Model(np.ones(toxicity.BUCKETS, np.float32), 0.0)
model.scores(["warm up"])
text = "lorem ipsum dolor sit amet idiot " * (2 << 20)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(text) > 64 << 20 and len(model.scores([text])) == 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(done.stdout) < 200
