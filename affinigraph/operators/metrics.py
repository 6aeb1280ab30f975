"""Quality of an assignment of points to clusters: rows of id, v, cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.blocks import matrix, nearest
from ..functions.vectors import squared_distance
from ..sources.points import width_of
from ..sources.store import settle, ship
from .lookup import looked_up


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"))


def centroids(assigned: DataFrame, width: int | None = None) -> DataFrame:
    """(cluster, c): mean vectors in the points' own space; one aggregate for each feature, no exploding."""
    width = width or width_of(assigned)
    means = assigned.groupBy("cluster").agg(*(F.avg(F.col("v")[k]).alias(f"m{k}") for k in range(width)))
    return means.select("cluster", F.array(*(f"m{k}" for k in range(width))).alias("c"))


def dispersion(assigned: DataFrame, width: int | None = None, centres: DataFrame | None = None) -> DataFrame:
    """(cluster, n, total, mean): squared distances of the points to their centroid, or to given, settled ``centres``."""
    width = width or width_of(assigned)
    centres = settle(centroids(assigned, width)) if centres is None else centres
    near = looked_up(assigned, centres, "cluster", F.col("id"), salts=16)
    d = squared_distance("v", "c", width)
    return near.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(d).alias("total"), F.avg(d).alias("mean"))


def wssse(assigned: DataFrame, width: int | None = None) -> DataFrame:
    return dispersion(assigned, width).agg(F.sum("total").alias("wssse"))


def ase(assigned: DataFrame, width: int | None = None) -> DataFrame:
    """Squares of the clusters' sums, over the number of points."""
    return dispersion(assigned, width).agg((F.sum(F.col("total") * F.col("total")) / F.sum("n")).alias("ase"))


def dbi(assigned: DataFrame, width: int | None = None) -> DataFrame:
    """Mean over clusters of the worst (mean_i + mean_j) / |c_i - c_j|**2; 0 for a single cluster. A pair of clusters
    with equal centres counts as infinitely bad."""
    width = width or width_of(assigned)
    centres = settle(centroids(assigned, width))
    c = settle(dispersion(assigned, width, centres).join(centres, "cluster"))
    a, b = (c.select(F.col("cluster").alias(i), F.col("mean").alias(f"m{i}"), F.col("c").alias(x)) for i, x in (("i", "x"), ("j", "y")))
    apart = squared_distance("x", "y", width)
    ratio = F.coalesce(F.try_divide(F.col("mi") + F.col("mj"), apart), F.lit(float("inf")))
    pairs = a.join(b, F.col("i") != F.col("j"), "left").withColumn("r", F.when(F.col("j").isNull(), 0.0).otherwise(ratio))
    worst = pairs.groupBy("i").agg(F.max("r").alias("r"))
    return worst.agg(F.avg("r").alias("dbi"))


def nearest_centre(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, v, cluster, d): the closest of k centres, ties to the smaller cluster, for each row. The centres, k rows, are
    sent; nothing is shuffled."""
    ship(points.sparkSession)
    rows = centres.orderBy("cluster").collect()
    y, names = np.array([r.c for r in rows], float), [r.cluster for r in rows]
    schema = points.select("id", "v").schema.add(centres.schema["cluster"]).add("d", "double")
    kind = to_arrow_type(centres.schema["cluster"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, at, d = nearest(matrix(b.column(1), b.num_rows), y, np.arange(len(y)), 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([names[k] for k in at], kind), pa.array(d)], names=["id", "v", "cluster", "d"])

    return points.select("id", "v").mapInArrow(run, schema)


def cost(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(cost): the sum of the squared distances of the points, as they are, to the closest of the given centres."""
    return nearest_centre(points, centres).agg(F.sum("d").alias("cost"))
