"""Connected components by alternating star operations, in tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweft.llm.shared import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` (long columns a, b); the component is its smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the smallest neighbour. A round's table is written once, so a lost executor
    costs that round. Loops and repeated edges don't matter; no edges, no rows.
    Rounds grow with the logarithm of the nodes; it raises if ``most_rounds`` don't do.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_before = None
    for _ in range(most_rounds):
        # large star: each node's larger neighbours go to the smallest of it and its neighbours
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        print_now = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if print_now == print_before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        print_before = print_now
    raise RuntimeError("components didn't settle")
