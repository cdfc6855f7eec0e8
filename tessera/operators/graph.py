"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tables import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (a, b: long).

    Each step is a minimum by node, which Spark combines before its shuffle, and a join that it
    can split where a node is hot. Ends when a round changes nothing; the table of each round is
    written to the shared folder."""

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return tidy(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small_star(e: DataFrame) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        return tidy(e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))

    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    e = written(tidy(edges.select("a", "b").where("a is not null and b is not null")), "edges")
    was = mark(e)
    for _ in range(rounds):
        e = written(small_star(large_star(e)), "edges")
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
