import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stowage.llm import decontamination as d


def bag(words):
    k = min(d.WIDTH, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    out = {}
    for n, (doc_id, text) in enumerate(docs):
        words = re.findall(r"[^\x00-\x2f:-@\[-`{-\x7f]+", (text or "").lower())
        for item_id, item in items:
            own = re.findall(r"[^\x00-\x2f:-@\[-`{-\x7f]+", (item or "").lower())
            if not own:
                continue
            k = min(d.WIDTH, len(own))
            b = bag(own)
            for s in range(len(words) - k + 1):
                window = words[s : s + len(own)]
                a = Counter(tuple(window[i : i + k]) for i in range(len(window) - k + 1))
                shared = (a & b).total()
                sim = shared / (a.total() + b.total() - shared)
                if sim >= 0.8 and sim > out.get((n, item_id), (0,))[0]:
                    out[n, item_id] = (sim, s)
    return sorted((docs[n][0], i, round(sim, 6), s) for (n, i), (sim, s) in out.items())


def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["été", "über", "an", "the"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 12, 30, 45, 70])))) for i in range(20)] + [(98, None), (99, " .. "), (3, "a repeated item number of eight words here")]
    docs = []
    for i in range(80):
        text = [rng.choice(words) for _ in range(rng.choice([0, 3, 40, 150]))]
        for _ in range(rng.randrange(3)):
            copy = items[rng.randrange(20)][1].split(" ")
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(["changed", "Über,", ""])
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + rng.choice(["", "!", ", --"]) for w in copy]
        docs.append((i, rng.choice([" ", "\n"]).join(text)))
    return docs + [(None, items[8][1]), (5, None), (5, "")], items


def test_against_brute_force(spark, tmp_path):
    docs, items = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(4)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = d.op5_decontamination(spark, str(tmp_path)).collect()
    key = lambda rows: sorted(rows, key=str)
    assert key((r.doc_id, r.item_id, round(r.similarity, 6), r.first_word) for r in got) == key(brute_all(docs, items))
    kept = d.clean(frame, spark.createDataFrame(items, "item_id long, text string"))
    bad = {r.doc_id for r in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for n, (i, t) in enumerate(docs) if not brute([(i, t)], items))
    assert kept.columns == ["doc_id", "text", "item_id"] and bad


def brute_all(docs, items):
    out = []
    for doc in docs:
        for item in items:
            out += brute([doc], [item])
    return out


def test_blocks_and_empty_tables(spark):
    docs, items = corpus()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    blocks = list(d.item_blocks(bench, 500))
    assert len(blocks) > 3 and sum(len(b.ids) for b in blocks) == 21
    assert d.matches(frame.limit(0), bench).count() == 0
    assert d.matches(frame, bench.limit(0)).count() == 0


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**64, (50, 2), dtype=np.uint64)
    index = d.MultiIndex(prints)
    for _ in range(200):
        near = prints[rng.integers(50)].copy()
        for bit in rng.choice(128, rng.integers(0, 60), replace=False):
            near[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        want = [(i, int(c)) for i, c in enumerate(np.bitwise_count(prints ^ near).sum(1)) if c <= d.RADIUS]
        assert index.near(near) == want


def test_thresholds_let_no_print_slip():
    for radius in (0, 3, 7, 20, 36):
        for blocks in (1, 4, 8):
            most = d.thresholds(radius, blocks)
            assert len(most) == blocks and sum(t + 1 for t in most) == radius + 1


def test_few_unrelated_prints_are_compared():
    rng = np.random.default_rng(2)
    index = d.MultiIndex(rng.integers(0, 2**64, (3000, 2), dtype=np.uint64))
    met = [len(index.met(p)) for p in rng.integers(0, 2**64, (50, 2), dtype=np.uint64)]
    assert 0.1 < np.mean(met) / 3000 < 0.25


def test_blocks_of_the_benchmark_give_the_same(spark):
    docs, items = corpus()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole, cut = (sorted(map(str, d.matches(frame, bench, n).collect())) for n in (d.BLOCK_BYTES, 500))
    assert whole == cut and whole
    assert sorted(str(r.doc_id) for r in d.clean(frame, bench, 500).collect()) == sorted(str(r.doc_id) for r in d.clean(frame, bench).collect())
