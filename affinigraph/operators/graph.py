"""From neighbours to affinities, degrees and the scaled graph matrix, all as rows (i, j, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import self_tuning_kernel, width_kernel
from ..sources.store import once
from .lookup import at_both_ends


def both_ways(near: DataFrame) -> DataFrame:
    """Every neighbour edge and its reverse, as a multiset: mutual neighbours and loops come twice. ``near`` is read once."""
    ways = F.array(F.struct("i", "j", "d"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return near.select(F.explode(ways).alias("e")).select("e.*")


def symmetric_edges(near: DataFrame) -> DataFrame:
    return both_ways(near).groupBy("i", "j").agg(F.min("d").alias("d"))


def mean_distances(near: DataFrame) -> DataFrame:
    """(i, mean): over the multiset of edges, before repeats are dropped."""
    return both_ways(near).groupBy("i").agg(F.avg("d").alias("mean"))


def self_tuned_affinity(near: DataFrame, power: int = 2) -> DataFrame:
    near = once(near)
    e = at_both_ends(symmetric_edges(near), mean_distances(near), "mean")
    return e.select("i", "j", self_tuning_kernel(F.col("d"), F.col("mean_i"), F.col("mean_j"), power).alias("s"))


def width_affinity(near: DataFrame, sigma: float, power: int = 2) -> DataFrame:
    return symmetric_edges(near).select("i", "j", width_kernel(F.col("d"), sigma, power=power).alias("s"))


def degrees(affinity: DataFrame) -> DataFrame:
    """(i, root): square root of each row's sum of affinities."""
    return affinity.groupBy("i").agg(F.sqrt(F.sum("s")).alias("root"))


def graph_matrix(affinity: DataFrame, scaling: str = "pos_half") -> DataFrame:
    """(i, j, w): s times the degree roots of both ends ("pos_half"), or divided by them ("sym")."""
    if scaling not in ("pos_half", "sym"):
        raise ValueError("scaling must be pos_half or sym")
    affinity = once(affinity)
    e = at_both_ends(affinity, degrees(affinity), "root")
    w = F.col("root_i") * F.col("s") * F.col("root_j") if scaling == "pos_half" else F.coalesce(F.try_divide(F.col("s"), F.col("root_i") * F.col("root_j")), F.lit(0.0))
    return e.select("i", "j", w.alias("w"))
