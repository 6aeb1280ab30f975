"""Rows looked up in a table of one row for each key, of which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import settle

#: Tables of at most so many bytes, measured as text, are sent to every task.
SENT_BYTES = 8 << 20


def looked_up(rows: DataFrame, settled: DataFrame, on: str, spread: Column, salts: int = 4, sent: int = SENT_BYTES) -> DataFrame:
    """The inner join with a settled table. A table of at most ``sent`` bytes is sent and no row moves; a larger one is repeated
    under ``salts`` numbers, and a row takes the number that its ``spread`` hashes to, so that a key's rows part."""
    size = settled.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0
    if size <= sent:
        return rows.join(F.broadcast(settled), on)
    salted = settled.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [on, "salt_"]).drop("salt_")


def at_both_ends(edges: DataFrame, stats: DataFrame, value: str, sent: int = SENT_BYTES) -> DataFrame:
    """Adds the statistic (i, ``value``) of each end as ``value_i`` and ``value_j``."""
    stats = settle(stats.select("i", value))
    i, j = stats.withColumnRenamed(value, f"{value}_i"), stats.select(F.col("i").alias("j"), F.col(value).alias(f"{value}_j"))
    return looked_up(looked_up(edges, i, "i", F.col("j"), sent=sent), j, "j", F.col("i"), sent=sent)
