"""Session, storage and Arrow helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import drop_path, new_path, ship


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of at most so many bytes, measured, are sent to every task; larger ones are joined by a shuffle.
SENT_BYTES = 8 << 20


def is_small(table: DataFrame) -> bool:
    """Whether a written table has at most SENT_BYTES, measured as text."""
    return (table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0) <= SENT_BYTES


def sent_if_small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(table) if is_small(table) else table


def joined_by(
    rows: DataFrame, keys: DataFrame, on: list[str], spread: Column, how: str = "inner", small: bool | None = None, salts: int = 16,
) -> DataFrame:
    """``rows`` joined with a table of one row for each key, of which one may hold a large share of the rows.

    A small table is sent; ``small`` is None to measure it, which it must be written for. A larger one is repeated under
    ``salts`` numbers and each row takes the number that its ``spread`` hashes to, so that no key's rows meet in one task.
    """
    if is_small(keys) if small is None else small:
        return rows.join(F.broadcast(keys), on, how)
    salted = keys.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt_", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [*on, "salt_"], how).drop("salt_")


@contextmanager
def written(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A table written as by materialize(), deleted at the end: for what is read within only."""
    ship(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    yield df.sparkSession.read.schema(df.schema).parquet(path)
    drop_path(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_id(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with one row for each non-null key; of several rows with one key the smallest text counts.

    Nulls order below every text only if all texts of the key are null. Rows without a key can't be named in a
    result, so operators that report by key leave them out.
    """
    return docs.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.min(text).alias("text"))


def sampled(df: DataFrame, h: Column, n: int) -> DataFrame:
    """Rows with the smallest hashes, some more than ``n`` of them: for bounded samples, so that an ordered limit gets few
    rows from each task however many tasks there are."""
    share = min(1.0, (1.2 * n + 1000) / max(1, df.count()))
    return df if share == 1 else df.where(h < F.lit(int(-(2**63) + share * 2**64)).cast("long"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_struct(df: DataFrame) -> Column:
    """All columns as one, ``row_``, so that helper columns can't clash with a table's own."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row_")


def from_struct(df: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The columns of ``row_`` again; ``new`` ones take the place of those of the same name, or follow."""
    own = [new.get(c, F.col("row_")[c]).alias(c) for c in columns]
    return df.select(*own, *(v.alias(k) for k, v in new.items() if k not in columns))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary Arrow array; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if len(col) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def split_batch(batch: pa.RecordBatch, text: str | int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each (a longer single text stays whole)."""
    offsets, _ = binary_buffers(batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
