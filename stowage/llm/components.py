"""Connected components of links between numbers, by smallest labels and pointer jumping.

Defined results: repeated links and links in both directions count once; a
link of a number with itself makes it a node; links with a null are left out; no
links in, no nodes out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.skew import spread_join
from stowage.tables import Scratch


def connected(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b); root is the smallest node that it reaches.

    In each round a node takes the smallest label among its neighbours, then
    the label of its label, so rounds grow with the logarithm of the longest
    path. Labels meet in aggregates combined before they are shuffled, and joins
    deal the rows of a frequent node or label to several tasks, so a node with
    very many links is no hot spot. Each round is written out.
    """
    links = links.where("a is not null and b is not null")
    pairs = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    pairs = scratch.store(pairs, f"{name}-pairs")
    labels = scratch.store(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), f"{name}-0")
    turn = 0
    while True:
        near = spread_join(pairs, labels.withColumnRenamed("node", "b"), ["b"]).groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(near, labels.node == near.a).select("node", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        moved = scratch.store(moved, f"{name}-moved")
        ahead = moved.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        turn += 1
        done = scratch.store(spread_join(moved, ahead, ["next"]).select("node", F.least("next", "jump").alias("root"), "was"), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", f"{name}-moved")
        labels = done.select("node", "root")
        if done.where("root <> was").isEmpty():
            scratch.drop(f"{name}-pairs")
            return labels
