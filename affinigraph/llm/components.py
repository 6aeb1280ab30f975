"""Connected components of a graph of links, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SENT_BYTES, joined_by, materialize

#: What a vertex and its minimum take as a row of a sent table, about.
ROW_BYTES = 32


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label): each vertex of ``edges`` (a, b) with the smallest id that it reaches.

    Alternates the large-star and small-star steps, which keep the components and end with stars around their minima in
    a number of rounds that grows with the logarithm of the size. Every round is a grouped minimum and a join, both
    spread over all tasks (a star's centre too), and its result is written to the shared folder.
    """
    e = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, n = None, e.count()
    for _ in range(rounds):
        small = 2 * n * ROW_BYTES <= SENT_BYTES  # a minimum for each vertex: no more than two for an edge
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = joined_by(both.where(F.col("b") > F.col("a")), low, ["a"], F.col("b"), small=small)
        large = materialize(large.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct(), "large_star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))
        star = joined_by(large, low, ["a"], F.col("b"), small=small).select(F.explode(ends).alias("x")).select("x.*")
        e = materialize(star.where(F.col("a") != F.col("b")).distinct(), "small_star")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before, n = now, now.n
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
