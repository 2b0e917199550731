import random

import corpus_pipeline
from pyspark.sql import functions as F

VOCABULARY = [a + b for a in "ka lo mi ra tu ve so ni".split() for b in "ber dan fol gim hus jor kel mon".split()]


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(5)

    def prose(n):
        return [rng.choice(VOCABULARY) for _ in range(n)]

    items = [" ".join(prose(30)) for _ in range(5)]
    rows, toxic = {}, set()
    for i in range(0, 300):
        words = prose(rng.randint(20, 200))
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "stupid"])
            toxic.add(i)
        rows[i] = " ".join(words)
    clean = [i for i in rows if i not in toxic]
    copies = {1000 + i: rows[i].replace(" ", "\n ", 3) for i in clean[:30]}
    near = {2000 + i: rows[i] + " " + rng.choice(VOCABULARY) for i in clean[30:60]}
    leaks = {3000 + k: " ".join(prose(20) + [t.upper()] + prose(20)) for k, t in enumerate(items)}
    texts = rows | copies | near | leaks | {4000: None, 4001: ""}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert len(kept[0] & toxic) <= 5 and len(set(texts) - toxic - kept[0]) <= 5
    lost = set(texts) - toxic - kept[0]
    assert kept[1] == kept[0] - {i for i in copies if i - 1000 in kept[0]} - {4001}
    assert kept[2] == kept[1] - {i for i in near if i - 2000 in kept[1]}
    assert kept[3] == kept[2] - set(leaks)
    assert kept[4] == kept[3]
    assert {i for i in clean if i not in lost} <= kept[4]
    bins = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("offset").alias("k")).collect()
    assert max(r.n for r in bins) <= 2048


def tables(spark, folder, rows, labels, items):
    columns = "doc_id long, text string, lang string, source string, n_chars long, _id string, _own int"
    spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in rows], columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(30_000))
    item = " ".join(f"item{i}" for i in range(40))
    rows = [(1, None), (2, ""), (None, "no number"), (3, "twice"), (3, "twice"), (3, "other text"), (4, long), (5, long + " end"), (6, f"before {item} after"), (7, "twice  ")]
    tables(spark, tmp_path, rows, [(1, None, None), (None, 1, 1)], [(1, item), (2, None)])
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    ids = sorted("-" if i != i else str(int(i)) for i in out[out["piece"] == 0]["doc_id"])
    assert ids == ["-", "1", "3", "3", "4"]
    assert (out.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
