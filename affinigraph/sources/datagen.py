"""Synthetic clustered points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import clamp_unit


def slices(spark: SparkSession, size: int, parts: int) -> DataFrame:
    """(part, start, end): ``size`` rows over ``parts`` slices, of which the first ``size % parts`` have one row more."""
    q, r = divmod(size, parts)
    part = F.col("id")
    start = F.when(part < r, part * (q + 1)).otherwise(part * q + r)
    end = F.when(part < r, (part + 1) * (q + 1)).otherwise((part + 1) * q + r)
    return spark.range(parts).select(part.alias("part"), start.cast("long").alias("start"), end.cast("long").alias("end"))


def centres(spark: SparkSession, k: int, features: int, seed: int = 23) -> DataFrame:
    """(cluster, v): uniform centres in the unit cube."""
    draws = np.random.default_rng(seed).random((k, features))
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(draws)], "cluster int, v array<double>")


def clustered_points(spark: SparkSession, records: int, features: int, k: int, scatter: float, parts: int = 8, seed: int = 23) -> DataFrame:
    """(id, cluster, v): a random centre plus one-sided uniform noise below ``scatter``, kept in [0, 1]."""
    near = centres(spark, k, features, seed).select("cluster", F.col("v").alias("centre"))
    rows = spark.range(0, records, 1, parts).withColumn("cluster", F.floor(F.rand(seed) * k).cast("int"))
    noisy = F.transform("centre", lambda x: clamp_unit(x + F.lit(float(scatter)) * F.rand(seed + 1)))
    return rows.join(F.broadcast(near), "cluster").select("id", "cluster", noisy.alias("v"))  # k rows of one width
