import itertools
import random

import pytest
from pyspark.sql import functions as F

from stowage.llm import components, near_join
from stowage.llm.near_join import Rule
from stowage.llm.words import shingle_sets
from stowage.tables import Scratch


def shingles(text, k):
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in (text or "")).split(" ") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def corpus(seed, n=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    rows = []
    while len(rows) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 9, 14, 16, 17, 40, 120, 300]))]
        if rng.random() < 0.3:
            words[1:1] = passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                i, kind = rng.randrange(len(copy)), rng.randrange(3)
                copy[i : i + 1] = [[rng.choice(vocabulary)], [], [copy[i].upper(), "x"]][kind] or copy[i : i + 1]
            rows.append((len(rows) + 5, rng.choice([" ", "\n", "\t "]).join(copy)))
    rows += [(1, None), (2, ""), (3, " \n"), (5, rows[0][1]), (None, rows[1][1]), (None, "alone in the world here now")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, k, percent", [(1, 4, 85), (2, 4, 85), (3, 5, 80)])
def test_components_against_brute_force(spark, seed, k, percent, monkeypatch):
    if seed == 2:  # every way beyond the size checks, and new orders
        monkeypatch.setattr(near_join, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(near_join, "LONG_LIST", 3)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("set_id", F.lit(1)).repartition(5)
    found = near_join.clusters(docs, Rule(k, percent)).toPandas()
    least = found.groupby("component")["doc_id"].min()
    got = [(None if i != i else int(i), int(n), None if c != c and i != i else int(i) if c != c else None if least[c] != least[c] else int(least[c])) for i, n, c in zip(found["doc_id"], found["n"], found["component"], strict=True)]
    assert sorted(got, key=str) == brute(rows, k, percent)


def test_sets_that_share_a_number_stay_apart(spark):
    rows = corpus(5, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rule = Rule(bits=5)
    found = near_join.clusters(docs, rule).toPandas()
    assert rule.shared
    least = found.groupby("component")["doc_id"].min()
    got = [(None if i != i else int(i), int(n), None if c != c and i != i else int(i) if c != c else None if least[c] != least[c] else int(least[c])) for i, n, c in zip(found["doc_id"], found["n"], found["component"], strict=True)]
    assert sorted(got, key=str) == brute(rows, 4, 85)


def test_words_that_cancel_out_are_not_equal(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one.upper())]
    found = near_join.clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {r.doc_id: r.component for r in found}
    assert of[1] != of[2] and of[1] == of[3]


def test_bounds_hold_for_all_sizes():
    for rule in (Rule(), Rule(5, 80), Rule(5, 50)):
        for n in range(1, 60):
            for m in range(n, 60):
                least = next((i for i in range(n + 1) if 100 * i >= rule.percent * (n + m - i)), None)
                if least is None:
                    assert m not in rule.partners(n) or rule.overlap(n, m) > n
                else:
                    assert rule.overlap(n, m) == least and m in rule.partners(n) and n in rule.partners(m)
                    assert (n - rule.prefix(n)) + 1 <= least and (m - rule.prefix(m)) + 1 <= least


def test_sketches_never_overrate():
    rng = random.Random(4)
    for _ in range(300):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 200))]
        other = [w for w in words if rng.random() < 0.9] + [f"v{rng.randrange(9)}" for _ in range(rng.randrange(30))]
        a, b = shingle_sets([" ".join(words).encode(), " ".join(other or ["x"]).encode()], 1)
        assert near_join.least_difference(near_join.sketch(a), near_join.sketch(b)) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_query_on_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert near_join.op8_ngram_jaccard_join(spark, str(tmp_path)).count() == 0


def test_keep_one(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(4, " ".join(base), "a"), (2, " ".join(base[1:]), "b"), (9, " ".join(base[:-1]), "c"), (1, "other text", "d"), (3, None, "e"), (None, " ".join(base + ["x"]), "f")]
    out = near_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string"), Rule(5, 80))
    assert sorted(r.lang for r in out.collect()) == ["b", "d", "e"] and out.columns == ["doc_id", "text", "lang"]


@pytest.mark.parametrize("limit", [None, 0])
def test_keep_one_keeps_columns_of_any_name(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(near_join, "BROADCAST_BYTES", limit)
    base = [f"w{i}" for i in range(100)]
    rows = [(4, " ".join(base), "a", 1), (2, " ".join(base[1:]), "b", 2), (7, "w1 w2 w3 w4 w5", "c", 3), (8, None, "d", 4), (9, None, "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _Text int").withColumn("_mine", F.lit(1)).withColumn("_bits", F.lit(2))
    out = near_join.keep_one(docs, Rule(5, 80))
    assert out.columns == docs.columns and sorted(r["_id"] for r in out.collect()) == ["b", "c", "d", "d"]


def test_hubs_connect(spark):
    rows = [(0, i) for i in range(1, 3000)] + [(5000 + i, 0) for i in range(10)] + [(8000, 8000), (None, 1), (8001, None)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(rows, "a long, b long"), Scratch(spark), "h").collect()}
    assert set(got) == {*range(3000), *range(5000, 5010), 8000} and {n for n, r in got.items() if r} == {8000}
    assert components.connected(spark.createDataFrame([], "a long, b long"), Scratch(spark), "e").count() == 0


def test_long_chains_connect(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components.connected(links, Scratch(spark), "c").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_kindred_sets_that_cannot_link_are_not_paired(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(1500)]
    rows = []
    for i in range(24):  # 0.69 alike
        rows.append((i, " ".join(base[:500] + [f"own{i}x{j}" for j in range(270)] + base[770:])))
    rows += [(100 + i, t + " end") for i, t in rows[:3]]
    rng.shuffle(rows)
    stored, store = {}, Scratch.store
    monkeypatch.setattr(Scratch, "store", lambda self, df, name: stored.setdefault(name, store(self, df, name)))
    monkeypatch.setattr(Scratch, "drop", lambda self, *names: None)
    found = near_join.clusters(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), Rule(5, 80)).collect()
    of = {r.doc_id: r.component for r in found}
    assert len(set(of.values())) == 24 and all(of[i] == of[100 + i] for i in range(3))
    assert stored["pairs"].count() <= 24
