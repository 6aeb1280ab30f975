"""Exact top-k by inner product of whole numbers: tiles of queries and shards, partial selection, and a tree of merges.

Candidates are packed into chunks of one width, as narrow integers, and chunks are dealt to shards; queries are dealt to blocks.
A tile is one shard and one block, and one task's group: it multiplies chunk by chunk, keeps the k best of each query so far
by partial selection, and returns one list for each query. Lists of a block are then merged, sixteen shards at a time, until
one is left. Shards, blocks and merges are bounded by bytes whatever the number of vectors, and nothing is approximate:
products are taken in doubles where they and their sums stay below 2 ** 53, in 64-bit integers below 2 ** 63, and in
unbounded ones beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, partitions_for, ship

RESULT = "query_id long, rank int, vec_id long, score long"
LISTS = "block long, node long, query_id long, vec_id long, score long"
#: Vectors of a chunk, bytes of a shard's chunks, and queries of a block; a merge takes FAN lists of each query.
CHUNK, SHARD_BYTES, BLOCK, FAN = 1024, 32 << 20, 1024, 16
PACKED = "width int, kind int, n int, ids binary, x binary"


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as the narrowest integers that hold all, or as Python's where 64 bits don't."""
    wide = np.floor(x * float(scale)) if not x.size or np.abs(x).max() < 2.0**62 / scale else None
    if wide is None:
        return np.array([[math.floor(v * scale) if abs(v) < 2.0**52 / scale else int(v) * scale for v in row] for row in x.tolist()], object)
    top = np.abs(wide).max(initial=0)
    return wide.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _pack(ids: list[int], x: np.ndarray, scale: int) -> tuple:
    """A chunk; of vectors beyond 64 bits (kind 0) the unscaled doubles are kept."""
    y = scaled(x, scale)
    kind = 0 if y.dtype == object else y.itemsize
    return x.shape[1], kind, len(ids), np.array(ids, "<i8").tobytes(), (np.ascontiguousarray(x, "<f8") if kind == 0 else np.ascontiguousarray(y)).tobytes()


def _unpack(r: dict, scale: int) -> tuple[np.ndarray, np.ndarray]:
    ids, shape = np.frombuffer(r["ids"], "<i8"), (r["n"], r["width"])
    if r["kind"] == 0:
        return ids, scaled(np.frombuffer(r["x"], "<f8").reshape(shape), scale)
    return ids, np.frombuffer(r["x"], f"<i{r['kind']}").reshape(shape)


def chunks(vectors: DataFrame, scale: int) -> DataFrame:
    """(width, kind, n, ids, x): the vectors of each partition, packed by width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list, list]] = {}

        def flush(width: int) -> pa.RecordBatch:
            ids, rows = open_.pop(width)
            cols = zip(*[_pack(ids, np.array(rows, float).reshape(len(ids), width), scale)], strict=True)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["width", "kind", "n", "ids", "x"])

        for b in batches:
            off = b.column(1).offsets.to_numpy().astype(np.int64)
            flat = b.column(1).values.to_numpy(zero_copy_only=False)
            for i, key in enumerate(b.column(0).to_pylist()):
                row = flat[off[i] : off[i + 1]]
                ids, rows = open_.setdefault(len(row), ([], []))
                ids.append(key)
                rows.append(row)
                if len(ids) >= CHUNK or len(ids) * max(1, len(row)) >= 1 << 20:
                    yield flush(len(row))
        for width in list(open_):
            yield flush(width)

    return vectors.select("vec_id", "v").mapInArrow(run, PACKED)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of every row of q and of x over the positions that both have; beyond 64 bits the nearest long."""
    m = min(q.shape[1], x.shape[1])
    q, x = q[:, :m], x[:, :m]
    top = int(abs(q).max(initial=0)) * int(abs(x).max(initial=0)) * max(1, m)
    if top < 1 << 53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    if top < 1 << 63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[min(max(sum(a * b for a, b in zip(r, s, strict=True)), low), high) for s in x.tolist()] for r in q.tolist()], np.int64).reshape(len(q), len(x))


def select(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, by score, then smaller id, in that order."""
    order = np.lexsort((ids, ~score, query))  # ~ turns the order of all longs around
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


class TopLists:
    """The k best of each query of a block so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query, self.vec, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(len(ids), np.iinfo(np.int64).min)  # of a full list

    def add(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Scores of the queries ``at`` (rows) with the candidates ``ids`` (columns); a query's own id is no candidate."""
        own = self.ids[at][:, None] == ids[None]
        floor = self.least[at]
        if score.shape[1] > self.k:
            held = np.where(own, np.iinfo(np.int64).min, score)
            floor = np.maximum(floor, np.partition(held, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((score >= floor[:, None]) & ~own)
        query = np.concatenate([self.query, at[i]])
        vec, score = np.concatenate([self.vec, ids[j]]), np.concatenate([self.score, score[i, j]])
        keep = select(query, vec, score, self.k)
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]
        last = np.nonzero(np.arange(len(keep)) - np.searchsorted(self.query, self.query) == self.k - 1)[0]
        self.least[self.query[last]] = self.score[last]


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows with the largest inner product of floor(scale * component) for each row under ``is_query``: query_id,
    rank from 1, vec_id, score. Ties go to smaller ids; a query has fewer rows only if there are fewer candidates.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. A query's own id is
    never its result; of query rows that share an id the smallest vector asks, and each other row that shares an id is a
    candidate. Vectors of unequal lengths are compared over the positions that both have. Scores beyond 64 bits count as the
    nearest long. An empty table, or one without queries, has no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    packed = materialize(chunks(v, scale), "chunks")
    asked = materialize(v.where("ask").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    size, n = packed.agg(F.sum(F.octet_length("x") + F.octet_length("ids"))).first()[0] or 0, asked.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    blocks = -(-n // BLOCK)
    shards = max(-(-size // SHARD_BYTES), min(packed.count(), -(-2 * partitions_for(spark) // blocks)))
    each = lambda count, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(name)
    dealt = packed.select(F.pmod(F.xxhash64("ids", "x"), F.lit(shards)).alias("node"), each(blocks, "block"), *(c.split()[0] for c in PACKED.split(", ")))
    told = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), each(shards, "node"), "vec_id", "v")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in LISTS.split(", ")]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names=names)
        widths: dict[int, list[int]] = {}
        asks = left.column("v").to_pylist()
        for i, a in enumerate(asks):
            widths.setdefault(len(a), []).append(i)
        own = np.array(left.column("vec_id").to_pylist(), np.int64)
        best = TopLists(own, k)
        sides = [(np.array(at), scaled(np.array([asks[i] for i in at], float).reshape(len(at), w), scale)) for w, at in widths.items()]
        for row in range(right.num_rows):
            ids, x = _unpack({c: right.column(c)[row].as_py() for c in ("width", "kind", "n", "ids", "x")}, scale)
            for at, q in sides:
                best.add(at, ids, products(q, x))
        m = len(best.query)
        block, node = left.column("block")[0].as_py(), right.column("node")[0].as_py()
        return pa.table([pa.array(c, pa.int64()) for c in (np.full(m, block), np.full(m, node), own[best.query], best.vec, best.score)], names=names)

    lists = told.groupBy("block", "node").cogroup(dealt.groupBy("block", "node")).applyInArrow(tile, LISTS)
    lists = materialize(lists, "tiles")

    def merge(t: pa.Table) -> pa.Table:
        query, vec, score = (t.column(c).to_numpy() for c in ("query_id", "vec_id", "score"))
        keep = pa.array(select(query, vec, score, k))
        return t.take(keep)

    while shards > 1:
        shards = -(-shards // FAN)
        lists = lists.withColumn("node", F.expr(f"node div {FAN}")).groupBy("block", "node").applyInArrow(merge, LISTS)

    def rank(t: pa.Table) -> pa.Table:
        query, vec, score = (t.column(c).to_numpy() for c in ("query_id", "vec_id", "score"))
        keep = select(query, vec, score, k)
        q = query[keep]
        place = np.arange(len(q)) - np.searchsorted(q, q) + 1
        return pa.table([pa.array(q), pa.array(place.astype(np.int32)), pa.array(vec[keep]), pa.array(score[keep])], names=["query_id", "rank", "vec_id", "score"])

    return lists.groupBy("block").applyInArrow(rank, RESULT)
