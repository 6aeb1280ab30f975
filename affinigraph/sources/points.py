"""Reading, writing and numbering point sets: DataFrames of ``id`` BIGINT and ``v`` ARRAY<DOUBLE>."""

from __future__ import annotations

import re
from weakref import WeakKeyDictionary

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import parse_line
from .store import settle

_widths: WeakKeyDictionary = WeakKeyDictionary()  # of tables that checked() wrote


def read_csv_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``v`` of each line of comma-separated doubles; a malformed line fails the query."""
    return spark.read.text(path).select(parse_line(F.col("value")).alias("v"))


def read_labelled_sparse(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", features) if features else reader).load(path)


def write_csv_vectors(points: DataFrame, path: str) -> None:
    """Replaces what is at ``path`` by one comma-separated line for each point."""
    points.select(csv_line()).write.mode("overwrite").text(path)


def csv_line(v: str = "v"):
    return F.concat_ws(",", F.col(v).cast("array<string>")).alias("value")


def from_rows(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """Literal rows, numbered in their order."""
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, v array<double>")


def points_of(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def column_view(v, positions: list[int]):
    """The values at ``positions`` of a vector column, repeats included."""
    return F.transform(F.array(*(F.lit(x) for x in positions)), lambda k: F.element_at(v, k + 1))


def distinct_vectors(points: DataFrame) -> DataFrame:
    """One row for each distinct vector, under its smallest id."""
    return points.groupBy("v").agg(F.min("id").alias("id")).select("id", "v")


def dense_index(points: DataFrame, order: str = "id") -> DataFrame:
    """Ids from 0 without gaps, in the order of a column.

    Rows are dealt by ranges and written with their range, as another run may sample other ranges; what is written is
    counted and numbered inside each range. The ranges' sizes, one number each, give the offsets, so no task sees more than
    its range.
    """
    dealt = settle(points.repartitionByRange(order).withColumn("part_", F.spark_partition_id()))
    base, total = [], 0
    for r in dealt.groupBy("part_").count().orderBy("part_").collect():
        base.append((r.part_, total))
        total += r["count"]
    local = dealt.withColumn("n_", F.row_number().over(Window.partitionBy("part_").orderBy(order)) - 1)
    offsets = points.sparkSession.createDataFrame(base, "part_ int, base_ long")
    return local.join(F.broadcast(offsets), "part_").withColumn("idx", F.col("base_") + F.col("n_")).drop("part_", "n_", "base_")  # a row for each range


def _width():
    return F.min("width_").alias("low"), F.max("width_").alias("high")


def _with_width(points: DataFrame) -> DataFrame:
    return points.withColumn("width_", F.col("v.size") if dict(points.dtypes)["v"].startswith("struct") else F.size("v"))


def _one_width(low: int | None, high: int | None) -> int:
    if low is None:
        raise ValueError("no points")
    if low != high:
        raise ValueError(f"vectors have between {low} and {high} values")
    return low


def width_of(points: DataFrame) -> int:
    """Width of the vectors; unequal widths are an error. Points from checked() are not read for it."""
    if points in _widths:
        return _widths[points]
    return _one_width(*_with_width(points).agg(*_width()).first())


def checked(points: DataFrame, n: int | None = None) -> tuple[DataFrame, int]:
    """(id, v) written once, and the number of points: ``n`` if it is given, else the rows written. Whatever later steps read, the
    input is evaluated by this one pass, which also finds what is wrong with it: no points, unequal widths, and an id that is not
    below a given ``n``, at which the pass ends. Each is a ValueError. Null ids pass."""
    rows = _with_width(points.select("id", "v"))
    given = n is not None and n >= 0
    if given:
        wrong = F.concat(F.lit("id "), F.col("id").cast("string"), F.lit(f" is not below the given number of points {n}; give none to count them"))
        rows = rows.withColumn("id", F.when(F.col("id") >= n, F.raise_error(wrong)).otherwise(F.col("id")))
    seen = Observation()
    try:
        kept = settle(rows.observe(seen, *_width()).drop("width_"))
    except PySparkException as e:
        found = re.search(r"id -?\d+ is not below the given number of points \d+; give none to count them", str(e))
        if found is None:
            raise
        raise ValueError(found[0]) from e
    # Smallest and largest width stay right if a task runs again; the number comes from what was written.
    _widths[kept] = _one_width(seen.get["low"], seen.get["high"])
    return kept, n if given else kept.count()
