import random

import numpy as np
from pyspark.sql import functions as F

from stowage.llm import quality

GOOD = "table chair river mountain paper window garden letter morning silver".split()


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(GOOD) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(4, 60))]
        good = int(i % 4 != 0)
        if not good:
            words = [w + "!!" for w in words] if i % 8 else [w for w in words for _ in range(12)]
        out.append((" ".join(words), good))
    return out


def test_learns():
    weights = quality.train([(t.encode(), k) for t, k in rows(400, 1)])
    held = rows(200, 2)
    made = quality.scores([t for t, _ in held], weights)
    assert np.mean((made >= 0.5) == np.array([k == 1 for _, k in held])) > 0.95
    assert quality.scores([None], weights) == quality.scores([""], weights)


def test_sparse_scores_by_brute_force():
    weights = np.random.default_rng(0).normal(size=quality.BUCKETS)
    text = ("a b! a b! " * 50).encode()
    (at, values), = quality.features([text])
    assert len(set(at.tolist())) == len(at) and np.isclose((values[1:] ** 2).sum(), 1)
    dense = np.zeros(quality.BUCKETS)
    dense[at] = values
    assert np.isclose(quality.scores([text.decode()], weights)[0], 1 / (1 + np.exp(-dense @ weights)))


def test_no_labels():
    assert quality.scores(["a b", None], quality.train([])).tolist() == [0.5, 0.5]


def test_query(spark, tmp_path):
    texts = rows(300, 3)
    data = [(i, t, 1) for i, (t, _) in enumerate(texts)] + [(None, None, None), (5, "again", 2)]
    spark.createDataFrame(data, "doc_id long, text string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, k) for i, (_, k) in enumerate(texts)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = quality.op3_quality(spark, str(tmp_path)).collect()
    assert len(out) == len(data)
    right = [r.predicted == texts[r.doc_id][1] for r in out if r.doc_id is not None and r.held_out and r.doc_id != 5]
    assert np.mean(right) > 0.9
    assert quality.score(spark.createDataFrame(data[:0], "doc_id long, text string, score int").withColumn("quality", F.lit(1)), np.zeros(quality.BUCKETS)).count() == 0
