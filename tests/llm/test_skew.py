from pyspark.sql import functions as F

from stowage.llm import skew


def test_spread_joins_are_joins(spark):
    key = F.when(F.col("id") < 4000, F.lit(7)).when(F.col("id") < 4500, F.lit(None)).otherwise(F.col("id")).alias("k")
    big = spark.range(6000).select(key, F.col("id").alias("v")).repartition(5)
    small = spark.range(7000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left"):
        got, want = skew.spread_join(big, small, ["k"], how), big.join(small, "k", how)
        assert sorted(map(tuple, got.select("k", "v", "w").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert skew.spread_join(big.limit(0), small, ["k"]).count() == 0


def test_sieves_lose_nothing(spark):
    made = skew.sieve(spark.range(0, 20000, 7), F.xxhash64("id"))
    tested = skew.sifted(spark.range(20000).withColumn("_bits", F.lit(1)), made, F.xxhash64("id"))
    assert tested.columns == ["id", "_bits", "_maybe"]
    assert tested.where("id % 7 = 0 and not _maybe").isEmpty()
    assert tested.where("id % 7 <> 0 and _maybe").count() < 20
    assert skew.sifted(spark.range(9), made.limit(0), F.xxhash64("id")).where("_maybe").isEmpty()
