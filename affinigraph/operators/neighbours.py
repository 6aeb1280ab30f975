"""Nearest neighbours: over all pairs, and inside buckets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import Nearest, matrix, squared_distances, turns
from ..functions.vectors import squared_distance
from ..sources.points import width_of
from ..sources.store import once, settle, ship
from . import sparse
from .lookup import looked_up

#: Points that a task holds of either side: two such blocks, and their distances in parts, fit it with ease.
BLOCK = 32_768
#: Smaller blocks than that are dealt together if there were more of them: a point moves once for each block that is dealt.
MOVED = 24
#: Buckets of at most so many points are one block.
SMALL = 128
#: Neighbours that a block keeps, and points (of 64 values) that a partition of blocks and their candidates holds.
KEPT, HELD = 1 << 21, 1 << 17


def blocks_for(n: int, block: int) -> int:
    """Blocks of at most ``block`` points; some more of a small set, so that several tasks share the pairs."""
    return max(1, -(-n // block), min(6, n // 256), min(12, n // 4096))


def dealt(n: int, block: int, most: int = BLOCK) -> int:
    """Blocks that points are dealt to: as blocks_for() has it, but of small blocks so many together that moving all points to
    every block stays in proportion to the points."""
    return min(blocks_for(n, block), max(MOVED, blocks_for(n, most)))


def dealt_of(size: Column, block: int) -> Column:
    """The same for a column of sizes."""
    few = [F.least(F.lit(6), F.floor(size / 256)), F.least(F.lit(12), F.floor(size / 4096)), F.lit(1)]
    return F.least(F.greatest(F.ceil(size / block), *few), F.greatest(F.lit(MOVED), F.ceil(size / BLOCK), *few))


def all_pairs(points: DataFrame, block: int = 4096) -> DataFrame:
    """(i, j, d) of every two points, each with itself too, joined block by block."""
    width = width_of(points)
    parts = blocks_for(points.count(), block)
    p = points.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asks = p.select(F.col("own").alias("a"), other.alias("b"), F.col("id").alias("i"), F.col("v").alias("x"))
    told = p.select(other.alias("a"), F.col("own").alias("b"), F.col("id").alias("j"), F.col("v").alias("y"))
    return asks.join(told, ["a", "b"]).select("i", "j", squared_distance("x", "y", width).alias("d"))


def pair_summary(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, n, total, low, high): how many points there are, and the sum, least and largest of each one's squared distances to all,
    itself included. Pairs of blocks are measured once for both sides, some rows at a time; a row for each point and block moves."""
    ship(points.sparkSession)
    width_of(points)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids, first = table.column("id").to_numpy(), table.column("first").to_numpy(zero_copy_only=False)
        v = matrix(table.column("v"), len(ids))
        alone = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        x, y = (v, v) if alone else (v[first], v[~first])
        if len(x) and len(y):
            total, low, high = np.zeros(len(y)), np.full(len(y), np.inf), np.full(len(y), -np.inf)
            for a, end in turns(len(x), len(y), 512):
                d = squared_distances(x[a:end], y)
                if not alone:
                    total, low, high = total + d.sum(axis=0), np.minimum(low, d.min(axis=0)), np.maximum(high, d.max(axis=0))
                yield _summary(ids[first][a:end], len(y), d.sum(axis=1), d.min(axis=1), d.max(axis=1))
            if not alone:
                yield _summary(ids[~first], len(x), total, low, high)

    parts = _pairs_of_blocks(points, F.lit(dealt(points.count(), block)), F.lit(0)).groupBy("bucket", "a", "b").applyInArrow(measure, "i long, n long, total double, low double, high double")
    return parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def _summary(i: np.ndarray, n: int, *values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), n)), *(pa.array(v) for v in values)], names=["i", "n", "total", "low", "high"])


def first_per_row(pairs: DataFrame, t: int) -> DataFrame:
    """The t smallest d of each i, ties to the smaller j."""
    order = Window.partitionBy("i").orderBy("d", "j")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= t).select("i", "j", "d", "rank")


def neighbours(points: DataFrame, t: int, block: int = BLOCK) -> DataFrame:
    """(i, j, d, rank): the t nearest points of each, itself included. Points may be sparse, in blocks a quarter as large."""
    if t < 1:
        raise ValueError(f"t must be 1 or more, not {t}")
    if sparse.is_sparse(points):
        points = once(points)  # made from entries that move: once, not for width, number and blocks each
    width, n = width_of(points), points.count()
    if sparse.is_sparse(points):
        most = BLOCK // 4
        return first_per_row(in_blocks(points, t, F.lit(dealt(n, min(block, most), most)), F.lit(0)), t)
    parts = swept_blocks(n, block, t)
    return swept(points.select("id", "v", F.lit(0).cast("long").alias("bucket"), F.lit(parts).alias("parts")), t, n * parts, width)


def swept_blocks(n: int, block: int, t: int) -> int:
    """Blocks of ``n`` points that a sweep keeps apart: as many as tasks may share, so few that moving all points to each stays in
    proportion to the points, more only if a block or its neighbours would be too large for a task."""
    t = max(1, min(t, n))
    few = max(1, min(MOVED, n // 256), -(-n // BLOCK), -(-n * t // KEPT))
    return max(few, min(MOVED, -(-n // block)))


def swept_blocks_of(size: Column, block: int, t: int, small: int = SMALL) -> Column:
    """The same for a column of sizes, of which there may be many: those of at most 4,096 points are one block each."""
    few = [F.ceil(size / BLOCK), F.least(F.lit(MOVED), F.ceil(size / 4096)), F.ceil(size * F.least(size, F.lit(t)) / KEPT)]
    cut = F.when(size > small, F.least(F.lit(MOVED), F.ceil(size / block))).otherwise(1)
    return F.greatest(F.lit(1), cut, *few).cast("int")


def swept(points: DataFrame, t: int, moved: int, width: int) -> DataFrame:
    """(i, j, d, rank): the t nearest of the same bucket. ``points``: id, v, bucket (a long), and ``parts``, the blocks of its bucket.

    A point is kept in its own block and passes each block of its bucket once; a task holds one block with what it has found
    and reads the others some rows at a time, so that no candidate moves. ``moved`` rows go to partitions of like size.
    """
    ship(points.sparkSession)
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    turn = F.explode(F.sequence(F.lit(-1), F.col("parts") - 1)).alias("turn")
    sent = points.where(F.col("bucket").isNotNull()).select("bucket", "id", "v", own.alias("own"), turn)
    sent = sent.select("bucket", F.when(F.col("turn") < 0, F.col("own")).otherwise(F.col("turn")).alias("block"), (F.col("turn") >= 0).alias("passes"), "id", "v")
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOVED * 2, -(-moved * width // (64 * HELD)))
    place = F.pmod(F.xxhash64("bucket") + F.col("block"), F.lit(tasks)).cast("int")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, near = None, [], None
        for b in batches:
            bucket, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            passes = b.column(2).to_numpy(zero_copy_only=False)
            ids, v = b.column(3).to_numpy(), matrix(b.column(4), b.num_rows)
            new = np.nonzero((np.diff(bucket) != 0) | (np.diff(block) != 0) | (np.diff(passes) != 0))[0] + 1
            for a, end in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
                if a == end:
                    continue
                if key != (bucket[a], block[a]):
                    yield from _kept(held, near)
                    key, held, near = (bucket[a], block[a]), [], None
                if not passes[a]:
                    held.append((ids[a:end].copy(), v[a:end].copy()))
                elif held:
                    if near is None:
                        held = [tuple(np.concatenate(c) for c in zip(*held, strict=True))]
                        near = Nearest(held[0][1], t)
                    near.add(v[a:end], ids[a:end])
        yield from _kept(held, near)

    rows = sent.repartitionById(tasks, place).sortWithinPartitions("bucket", "block", "passes")
    return rows.mapInArrow(sweep, "i long, j long, d double, rank int")


def _kept(held: list, near: Nearest | None) -> Iterator[pa.RecordBatch]:
    if near is not None:
        for i, to, d, rank in near.found():
            yield pa.RecordBatch.from_arrays([pa.array(held[0][0][i]), pa.array(to), pa.array(d), pa.array(rank.astype(np.int32))], names=["i", "j", "d", "rank"])


def _pairs_of_blocks(points: DataFrame, blocks: Column, bucket: Column) -> DataFrame:
    """(bucket, a, b, id, v, first): the points of each two blocks a and b of a bucket, ``first`` those of a."""
    p = points.select("id", "v", bucket.alias("bucket"), blocks.cast("int").alias("parts"))
    p = p.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    sent = p.select("bucket", "id", "v", "own", other)
    return sent.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "id", "v", (F.col("own") <= F.col("other")).alias("first"))


def in_blocks(points: DataFrame, t: int, blocks, bucket) -> DataFrame:
    """Candidates (i, j, d) of sparse points: each pair of blocks of a bucket is compared once, by one task, which keeps t for each
    row of either. ``blocks``: how many a bucket has."""
    ship(points.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids, first = table.column("id").to_numpy(), table.column("first").to_numpy(zero_copy_only=False)
        v = sparse.Rows.of(table.column("v"))
        alone = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        part = lambda which: v.take(np.nonzero(which)[0])
        sides = [(v, ids)] if alone else [(part(first), ids[first]), (part(~first), ids[~first])]
        for (x, own), (y, to) in [(sides[0], sides[-1]), (sides[-1], sides[0])][: len(sides)]:
            if len(x) and len(y):
                for row, at, dist in sparse.nearest_in_turns(x, y, to, t):
                    yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(to[at]), pa.array(dist)], names=["i", "j", "d"])

    return _pairs_of_blocks(points, blocks, bucket).groupBy("bucket", "a", "b").applyInArrow(compare, "i long, j long, d double")


def neighbour_count(n: int, share: float) -> int:
    """Neighbours for each point that a share of all points makes, rounded up."""
    return math.ceil(n * share)


def bucket_neighbours(points: DataFrame, t: int, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(i, j, d, rank): the t nearest points of the same bucket, itself included. ``points``: id, v, bucket.

    Buckets of at most ``small`` points are one block; larger ones are swept block by block, so that one bucket that holds most
    points is work for many tasks.
    """
    if t < 1:
        raise ValueError(f"t must be 1 or more, not {t}: the share is too small for so few points")
    width = width_of(points)
    points = points.select("id", "v", F.col("bucket").cast("long").alias("bucket"))
    sizes = settle(points.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("size_")))
    sizes = sizes.withColumn("parts", swept_blocks_of(F.col("size_"), block, t, small))
    moved = sizes.agg(F.sum(F.col("size_") * (F.col("parts") + 1))).first()[0] or 0
    return swept(looked_up(points, sizes, "bucket", F.col("id"), salts=16), t, moved, width)
