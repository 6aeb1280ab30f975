"""Approximate nearest neighbours by cosine: an inverted-list index scanned dimension block by dimension block.

Vectors are normalised and rotated by a random orthogonal matrix, which spreads their length evenly over the dimensions.
Within a probed list, a candidate's partial distance over the dimensions seen so far is tested against the distance that it
must beat: under the hypothesis that it does, the partial distance exceeds its share by more than the test's factor only
rarely, so such candidates are abandoned. Survivors are compared on the original vectors, in double precision, and tighten
the distance to beat as the scan goes on.

Which lists a query probes is its own matter, in two rounds. The first takes its nearest lists until they hold more than k
vectors, so that k results are always held. The second takes every other list that may do better: by the cosines of query
and members to the list's centroid, a list out of reach is ruled out for certain, and the least promising others as long as
the neighbours expected in them stay below the share that the recall allows.

Equal vectors are searched for once, and are candidates once, with their k + 1 smallest ids. Centroids are fitted on a
bounded sample; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, partitions_for, sampled, ship

RESULT = "query_id long, rank int, vec_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def upper_tail(z: np.ndarray) -> np.ndarray:
    """How rarely a normal variable exceeds z, to some percent, never much too low."""
    a = np.abs(z)
    tail = 0.5 * np.exp(-0.717 * a - 0.416 * a * a)
    return np.where(z > 0, tail, 1 - tail)


@dataclass
class ListIndex:
    """Rotation, centroids, what is known of the lists' members, and how freely members spread around their centroid."""

    rotation: np.ndarray
    centroids: np.ndarray
    freedom: float = 0.0
    size: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cosine: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))  # least, mean and largest of the members to the centroid

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, recall: float, k: int, rounds: int = 8, seed: int = 11) -> ListIndex:
        """Spherical k-means. ``freedom``: the dimensions that residuals fill, lowered until the rule by which lists are left
        out holds ``recall`` of the true neighbours in the sample."""
        rng, d = np.random.default_rng(seed), sample.shape[1]
        x = unit(sample)
        lists = max(1, min(lists, len(x) // 16))
        c = x[rng.choice(len(x), lists, replace=False)]
        for _ in range(rounds):
            own = (x @ c.T).argmax(axis=1)
            total = np.zeros_like(c)
            np.add.at(total, own, x)
            length = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(length > 1e-9, total / np.maximum(length, 1e-9), c)
        near = x @ c.T
        own = near.argmax(axis=1)
        index = cls(np.linalg.qr(rng.normal(size=(d, d)))[0], c)
        index.describe(own, near[np.arange(len(x)), own])
        spread = np.linalg.eigvalsh(np.cov((x - near[np.arange(len(x)), own][:, None] * c[own]).T).reshape(d, d)) if len(x) > 1 else np.zeros(1)
        index.freedom = float(spread.sum() ** 2 / max((spread**2).sum(), 1e-300))
        ask = rng.choice(len(x), min(300, len(x)), replace=False)
        all_near = x[ask] @ x.T
        all_near[np.arange(len(ask)), ask] = -2
        k = min(k, len(x) - 1)
        best = np.argsort(-all_near, axis=1)[:, :k]
        while k and index.freedom >= 1:
            kept = index.worth(near[ask], np.take_along_axis(all_near, best[:, -1:], axis=1)[:, 0], recall, k)
            if kept[np.arange(len(ask))[:, None], own[best]].mean() >= recall:
                break
            index.freedom *= 0.7
        return index

    def describe(self, own: np.ndarray, cosine: np.ndarray) -> None:
        self.size = np.bincount(own, minlength=len(self.centroids))
        least, most = np.ones(len(self.size)), -np.ones(len(self.size))
        np.minimum.at(least, own, cosine)
        np.maximum.at(most, own, cosine)
        self.cosine = np.stack([least, np.bincount(own, cosine, len(self.size)) / np.maximum(self.size, 1), most], axis=1)

    def first(self, near: np.ndarray, k: int) -> np.ndarray:
        """For each query (cosines to the centroids), its nearest lists that together hold more than k vectors."""
        order = np.argsort(-near, axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        out = np.zeros(near.shape, bool)
        np.put_along_axis(out, order, (before <= k) & (self.size[order] > 0), axis=1)
        return out

    def worth(self, near: np.ndarray, score: np.ndarray, recall: float, k: int) -> np.ndarray:
        """For each query the lists that are not left out, given the score that a member has to reach."""
        a = np.clip(near, -1, 1)
        angle, far, close = np.arccos(a), np.arccos(np.clip(self.cosine[:, 0], -1, 1)), np.arccos(np.clip(self.cosine[:, 2], -1, 1))
        apart = np.maximum(0, np.maximum(angle - far, close - angle))
        possible = (np.cos(apart) >= score[:, None] - 1e-9) & (self.size > 0)
        hits = np.zeros(near.shape)
        for b in self.cosine.T:
            room = np.sqrt(np.maximum((1 - a * a) * (1 - b * b), 1e-12))
            hits = np.maximum(hits, self.size * upper_tail((score[:, None] - a * b) / room * np.sqrt(max(self.freedom, 1e-9))))
        hits[~possible] = 0
        order = np.argsort(hits, axis=1, kind="stable")
        few = np.cumsum(np.take_along_axis(hits, order, axis=1), axis=1) <= 0.5 * (1 - recall) * k
        out = np.zeros(near.shape, bool)
        np.put_along_axis(out, order, ~few, axis=1)
        return out & possible if self.freedom >= 1 else possible


class Search:
    """The best results of some queries so far, and the scan of further candidates."""

    def __init__(self, raw: np.ndarray, rotated: np.ndarray, beat: np.ndarray, k: int, strictness: float, dims: int):
        self.raw, self.rotated, self.k, self.strictness, self.dims = raw, rotated, k, strictness, dims
        self.length = np.sqrt((raw * raw).sum(axis=1))
        self.limit = np.where(np.isfinite(beat), 2 - 2 * beat + 1e-6, np.inf)  # squared distance of unit vectors
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def scan(self, asks: np.ndarray, raw: np.ndarray, rotated: np.ndarray, ids: np.ndarray, owner: np.ndarray) -> None:
        """Candidates of a list for the queries ``asks``. ``ids`` and ``owner``: ids, and whose vector each is."""
        d = rotated.shape[1]
        for a in range(0, len(asks), 1024):
            q = asks[a : a + 1024]
            for b in range(0, len(raw), 1024):
                x = rotated[b : b + 1024]
                limit = self.limit[q]
                none = np.isinf(limit)
                if none.any() and len(x) >= self.k:
                    whole = 2 - 2 * self.rotated[q[none]] @ x.T
                    limit[none] = np.partition(whole, self.k - 1, axis=1)[:, self.k - 1] + 2e-5
                head = self.rotated[q][:, : self.dims]
                part = (head**2).sum(axis=1)[:, None] + (x[:, : self.dims] ** 2).sum(axis=1)[None] - 2 * head @ x[:, : self.dims].T
                i, j = np.nonzero(part <= self._bound(limit, min(self.dims, d), d)[:, None])
                part = part[i, j]
                for at in range(self.dims, d, self.dims):
                    seen = min(at + self.dims, d)
                    for s in range(0, len(i), 65_536):
                        p, r = i[s : s + 65_536], j[s : s + 65_536]
                        diff = self.rotated[q[p], at:seen] - x[r, at:seen]
                        part[s : s + 65_536] += np.einsum("ij,ij->i", diff, diff)
                    keep = part <= self._bound(limit, seen, d)[i]
                    i, j, part = i[keep], j[keep], part[keep]
                for s in range(0, len(i), 65_536):
                    self._add(q[i[s : s + 65_536]], j[s : s + 65_536] + b, raw, ids, owner)

    def _bound(self, limit: np.ndarray, seen: int, d: int) -> np.ndarray:
        """The largest partial distance that a candidate within the limit has but rarely."""
        return limit * (seen / d) * (1 + (self.strictness / np.sqrt(seen) if seen < d else 0)) ** 2 + 1e-5

    def _add(self, q: np.ndarray, c: np.ndarray, raw: np.ndarray, ids: np.ndarray, owner: np.ndarray) -> None:
        x = raw[c]
        score = (x * self.raw[q]).sum(axis=1) / (self.length[q] * np.sqrt((x * x).sum(axis=1)))
        first, end = np.searchsorted(owner, c), np.searchsorted(owner, c, "right")
        n = end - first
        at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q, i, s = (np.concatenate(x) for x in ((self.query, np.repeat(q, n)), (self.id, ids[at]), (self.score, np.repeat(score, n))))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.query, self.id, self.score = q[keep], i[keep], s[keep]
        last = rank == self.k - 1
        self.limit[q[last]] = np.minimum(self.limit[q[last]], 2 - 2 * s[last] + 1e-6)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.97, sample: int = 10_000, strictness: float = 2.5,
    dims_a_block: int = 16, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows found for each row under ``is_query``: query_id, rank from 1, vec_id, score. A query has ``k``
    rows, or one for each other vector if these are fewer; ties go to smaller ids.

    Null, zero or non-finite vectors, those of another length than most, and rows without an id take no part; of rows that
    share an id the smallest vector counts, and a query among them makes it a query. There is a list for each square root of
    the vectors, up to a 16th of the sample; lists are dealt to cells of bounded size, a large list to several.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    v = materialize(v.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("ask").alias("ask")), "vectors")
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not common:
        return spark.createDataFrame([], RESULT)
    dim, k1 = common[0].d, k + 1
    v = v.where(F.size("v") == dim)
    # equal vectors once, under their smallest id; any query needs k + 1 of their ids at most
    few = v.select("v", "vec_id", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")).alias("nth")).where(F.col("nth") <= k1)
    distinct = materialize(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("id"), "v", "ids"), "distinct")
    asked = materialize(v.where("ask").select("v", F.col("vec_id").alias("query_id")).join(distinct.select("id", "v"), "v").select("query_id", "id"), "asked")
    n = distinct.count()
    rows = sampled(distinct, F.xxhash64("id"), sample).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    index = ListIndex.fit(np.array([r.v for r in rows]), max(16, round(n**0.5)), recall, k1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                near = unit(x) @ index.centroids.T
                own = near.argmax(axis=1)
                cols = [pa.array(own.astype(np.int32)), pa.array(near[np.arange(len(x)), own]), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)]
                yield pa.RecordBatch.from_arrays(cols, names=["list", "cosine", "id", "raw", "ids"])

    placed = materialize(distinct.select("id", "v", "ids").mapInArrow(place, "list int, cosine double, id long, raw binary, ids array<long>"), "lists")
    stats = placed.groupBy("list").agg(F.count("*").alias("n"), F.min("cosine").alias("a"), F.avg("cosine").alias("b"), F.max("cosine").alias("c")).collect()  # a row for each list
    index.size, index.cosine = np.zeros(len(index.centroids), np.int64), np.ones((len(index.centroids), 3))
    for r in stats:
        index.size[r.list], index.cosine[r.list] = r.n, (r.a, r.b, r.c)

    # neighbouring lists share a cell, a large list has several
    room = int(np.clip(n / (4 * partitions_for(spark)), 2048, 32_768))
    axis = np.linalg.svd(index.centroids - index.centroids.mean(axis=0), full_matrices=False)[2][0]
    base, parts, cell, filled = np.zeros(len(index.size), np.int64), np.ones(len(index.size), np.int64), 0, 0
    for own in np.argsort(index.centroids @ axis, kind="stable"):
        m = int(index.size[own])
        if filled and filled + m > room:
            cell, filled = cell + 1, 0
        base[own], parts[own] = cell, max(1, -(-m // room))
        filled += m
        if m > room:
            cell, filled = cell + int(parts[own]), 0
    cells = cell + 1
    plan = spark.createDataFrame([(i, int(b), int(p)) for i, (b, p) in enumerate(zip(base, parts, strict=True))], "list int, base long, parts long")
    held = placed.join(F.broadcast(plan), "list").select((F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("cell"), "id", "list", "raw", "ids")  # at most sample / 16 rows sent

    def wanted(x: np.ndarray, beat: np.ndarray | None) -> np.ndarray:
        near = unit(x) @ index.centroids.T
        first = index.first(near, k1)
        return first if beat is None else index.worth(near, beat, recall, k1) & ~first

    def ask_cells(again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, 256):
                    b = whole.slice(a, 256)
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    beat = b.column(2).to_numpy(zero_copy_only=False)
                    lists = wanted(x, beat if again else None)
                    hit = np.zeros((len(x), cells), bool)
                    for i in np.nonzero(lists.any(axis=0))[0]:
                        hit[:, base[i] : base[i] + parts[i]] |= lists[:, i : i + 1]
                    q, c = np.nonzero(hit)
                    raw = [r.tobytes() for r in x]
                    cols = [pa.array(c), pa.array(b.column(0).to_numpy()[q]), pa.array([raw[i] for i in q], pa.binary()), pa.array(beat[q])]
                    yield pa.RecordBatch.from_arrays(cols, names=["cell", "id", "raw", "beat"])

        return run

    def search(again: bool):
        def run(table: pa.Table) -> pa.Table:
            asks = pa.compute.is_null(table.column("list")).to_numpy()
            raw = np.frombuffer(b"".join(table.column("raw").to_pylist()), np.float64).reshape(-1, dim)
            rotated = (unit(raw) @ index.rotation).astype(np.float32)
            beat = np.nan_to_num(table.column("beat").to_numpy()[asks], nan=-np.inf)
            lists = wanted(raw[asks], beat if again else None)
            s = Search(raw[asks], rotated[asks], beat if again else np.full(int(asks.sum()), -np.inf), k1, strictness, dims_a_block)
            of = table.column("list").to_numpy(zero_copy_only=False)
            for own in np.unique(of[~asks]).astype(int):
                c, q = np.nonzero(~asks & (of == own))[0], np.nonzero(lists[:, own])[0]
                if len(q):
                    ids = table.column("ids").take(pa.array(c)).combine_chunks()
                    s.scan(q, raw[c], rotated[c], ids.flatten().to_numpy(), np.repeat(np.arange(len(c)), ids.value_lengths().to_numpy()))
            mine = table.column("id").to_numpy()[asks]
            return pa.table([pa.array(mine[s.query]), pa.array(s.id), pa.array(s.score)], names=["id", "vec_id", "score"])

        return run

    def one_round(queries: DataFrame, again: bool) -> DataFrame:
        sent = materialize(queries.mapInArrow(ask_cells(again), "cell long, id long, raw binary, beat double"), "asks")
        turns = sent.groupBy("cell").agg((F.floor((F.count("*") - 1) / 32_768) + 1).alias("turns"))
        q = sent.join(turns, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("turns")).alias("turn"), "id", F.lit(None).cast("int").alias("list"), "raw", F.lit(None).cast("array<long>").alias("ids"), "beat")
        c = held.join(turns, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "id", "list", "raw", "ids", F.lit(None).cast("double").alias("beat"))
        return c.unionByName(q).groupBy("cell", "turn").applyInArrow(search(again), "id long, vec_id long, score double")

    by_score = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k1)
    queries = asked.select("id").distinct().join(distinct.select("id", "v"), "id").select("id", "v")
    found = materialize(one_round(queries.withColumn("beat", F.lit(None).cast("double")), False), "first")
    beat = best(found).groupBy("id").agg(F.when(F.count("*") == k1, F.min("score")).alias("beat"))
    more = one_round(queries.join(beat, "id", "left").select("id", "v", F.coalesce("beat", F.lit(-2.0)).alias("beat")), True)
    near = best(found.unionByName(more)).select("id", "vec_id", "score")
    own = asked.join(near, "id").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
