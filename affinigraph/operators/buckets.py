"""Hash buckets: features drawn by their span, thresholds at sparse places, greedy grouping of signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import matrix
from ..functions.vectors import bin_of, java_doubles, signature
from ..sources.points import dense_index, width_of
from ..sources.store import settle, ship

BINS = 20


def column_stats(points: DataFrame, width: int | None = None) -> DataFrame:
    """(pos, low, high): a task reduces its vectors, of any width, to one row for each feature. NaN counts as the largest
    value, as in SQL; no points give no rows."""
    ship(points.sparkSession)
    width = width or width_of(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(width, np.nan), np.full(width, -np.inf)
        seen = False
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), b.num_rows)
                low, high, seen = np.fmin(low, np.fmin.reduce(x)), np.maximum(high, x.max(axis=0)), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(low), pa.array(high)], names=["pos", "low", "high"])

    return points.select("v").mapInArrow(run, "pos int, low double, high double").groupBy("pos").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def span_shares(stats: DataFrame) -> DataFrame:
    """(pos, low, step, share, cumulative): each feature's part of the sum of spans. One row for each feature."""
    span = F.abs(F.col("high") - F.col("low"))
    order = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    s = stats.withColumn("share", F.coalesce(F.try_divide(span, F.sum(span).over(total)), F.lit(0.0)))
    return s.select("pos", "low", (span / BINS).alias("step"), "share", F.sum("share").over(order).alias("cumulative"))


def bit_count(n: int) -> int:
    """Hash bits for n points."""
    return max(math.ceil(math.log2(n)) if n > 0 else 0, 20)


def draw_features(spans: DataFrame, bits: int, seed: int = 3) -> DataFrame:
    """(bit, pos): features drawn by inverse cumulative share. The first feature's range is open at its end, the others
    include both ends, so that of two the lower feature is taken; a draw in no range takes feature 0."""
    spark = spans.sparkSession
    draws = spark.createDataFrame(list(enumerate(java_doubles(seed, bits))), "bit int, u double")
    ranges = spans.select("pos", (F.col("cumulative") - F.lit(0.0)).alias("high"), F.lag("cumulative").over(Window.orderBy("pos")).alias("low"))
    hit = ((F.col("pos") == 0) & (F.col("u") < F.col("high"))) | ((F.col("pos") > 0) & (F.col("u") >= F.col("low")) & (F.col("u") <= F.col("high")))
    return draws.join(F.broadcast(ranges), hit, "left").groupBy("bit").agg(F.coalesce(F.min("pos"), F.lit(0)).alias("pos"))  # a row for each feature


def histogram(points: DataFrame, features: DataFrame, spans: DataFrame) -> DataFrame:
    """(bit, bin, n) over all bins, empty ones too. Values are binned once for each distinct feature."""
    used = features.select("pos").distinct().join(spans, "pos").select("pos", "low", "step")
    wanted = sorted(r.pos for r in used.select("pos").collect())
    values = points.select(F.explode(F.array(*(F.struct(F.lit(p).alias("pos"), F.col("v")[p].alias("x")) for p in wanted))).alias("c")).select("c.*")
    binned = values.join(F.broadcast(used), "pos").select("pos", bin_of(F.col("x"), F.col("low"), F.col("step")).alias("bin"))  # a row for each feature
    counts = binned.groupBy("pos", "bin").agg(F.count("*").alias("n"))
    spine = features.select("bit", "pos", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    return spine.join(counts, ["pos", "bin"], "left").select("bit", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def thresholds(hist: DataFrame, features: DataFrame, spans: DataFrame) -> DataFrame:
    """(bit, pos, threshold): the lower end of the emptiest bin; of several the middle one."""
    least = hist.withColumn("least", F.min("n").over(Window.partitionBy("bit"))).where(F.col("n") == F.col("least"))
    nth = least.withColumn("nth", F.row_number().over(Window.partitionBy("bit").orderBy("bin")) - 1).withColumn("ties", F.count("*").over(Window.partitionBy("bit")))
    middle = nth.where(F.col("nth") == F.floor(F.col("ties") / 2)).select("bit", "bin")
    return middle.join(features, "bit").join(spans, "pos").select("bit", "pos", (F.col("low") + F.col("bin") * F.col("step")).alias("threshold"))


def fit_hash(points: DataFrame, n: int | None = None, seed: int = 3) -> DataFrame:
    """(bit, pos, threshold) learnt from the points."""
    spans = settle(span_shares(column_stats(points)))
    features = settle(draw_features(spans, bit_count(points.count() if n is None or n < 0 else n), seed))
    return settle(thresholds(histogram(points, features, spans), features, spans))


def signatures(points: DataFrame, hash_bits: DataFrame) -> DataFrame:
    rows = hash_bits.orderBy("bit").collect()  # one row for each bit
    return points.withColumn("sig", signature("v", [r.pos for r in rows], [r.threshold for r in rows]))


def distinct_signatures(signed: DataFrame) -> DataFrame:
    return signed.groupBy("sig").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


def lead_signatures(sigs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(sig, bucket) of (sig, first id) pairs: in order of first ids, each joins the earliest leader within one bit or
    leads a bucket of its own. The leaders within one bit are looked up, so the pass is linear in the signatures."""
    leaders: dict[int, int] = {}
    out = []
    for sig, _ in sorted(sigs, key=lambda x: x[1]):
        near = [leaders[s] for s in (sig, *(sig ^ (1 << b) for b in range(63))) if s in leaders]
        bucket = min(near) if near else leaders.setdefault(sig, len(leaders))
        out.append((sig, bucket))
    return out


def lead_in_rounds(distinct: DataFrame, rounds: int = 200) -> DataFrame:
    """(sig, bucket) as lead_signatures() has it, without gathering the signatures: in each round those of which all earlier
    neighbours within one bit are settled are settled too. A signature with an earlier leader next to it joins one; one
    without any leads. Rounds follow the longest chain of ever later neighbours, which is short in a mixed order."""
    order = distinct.select("sig", "first_id")
    pairs = hamming_pairs(distinct).select(F.explode(F.array(F.struct("s1", "s2"), F.struct(F.col("s2").alias("s1"), F.col("s1").alias("s2")))).alias("x")).select("x.*")
    first = lambda c: order.select(F.col("sig").alias(c), F.col("first_id").alias(f"{c}_at"))
    pairs = settle(pairs.join(first("s1"), "s1").join(first("s2"), "s2").where("s2_at < s1_at").select(F.col("s1").alias("sig"), F.col("s2").alias("near")))
    state = order.withColumn("leads", F.lit(None).cast("boolean"))
    for _ in range(rounds):
        seen = pairs.join(state.select(F.col("sig").alias("near"), F.col("leads").alias("l")), "near")
        seen = seen.groupBy("sig").agg(F.max(F.coalesce("l", F.lit(False))).alias("any"), F.max(F.col("l").isNull()).alias("open"))
        told = F.when(F.coalesce("any", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = settle(state.join(seen, "sig", "left").select("sig", "first_id", F.coalesce("leads", told).alias("leads")))
        if state.where(F.col("leads").isNull()).limit(1).count() == 0:
            break
    else:
        raise RuntimeError("the buckets are not settled")
    leaders = dense_index(state.where("leads").select("sig", "first_id"), "first_id").select("sig", F.col("idx").cast("int").alias("bucket"))
    next_to = pairs.join(leaders.withColumnRenamed("sig", "near"), "near").groupBy("sig").agg(F.min("bucket").alias("bucket"))
    return leaders.unionByName(state.where("NOT leads").select("sig").join(next_to, "sig"))


def buckets(signed: DataFrame, most: int = 100_000) -> DataFrame:
    """Adds ``bucket`` to points with ``sig``. Up to ``most`` distinct signatures are grouped on the driver, more in rounds of
    joins; both give the same buckets."""
    distinct = settle(distinct_signatures(signed))
    if distinct.count() > most:
        return signed.join(lead_in_rounds(distinct), "sig")
    pairs = [(r.sig, r.first_id) for r in distinct.collect()]
    table = signed.sparkSession.createDataFrame(lead_signatures(pairs), "sig long, bucket int")
    return signed.join(table, "sig")


def lsh_buckets(points: DataFrame, hyperplanes: list[int], levels: list[float]) -> DataFrame:
    """Buckets for given features and thresholds, one for each bit."""
    return buckets(points.withColumn("sig", signature("v", hyperplanes, levels)))


def hamming_pairs(signed: DataFrame) -> DataFrame:
    """(s1, s2): distinct signatures, s1 < s2, that differ in one bit. Each is joined with its one-bit variants."""
    s = signed.select("sig").distinct()
    flips = reduce(lambda a, b: a + [F.col("sig").bitwiseXOR(F.lit(1 << b))], range(62), [])
    near = s.select(F.col("sig").alias("s1"), F.explode(F.array(*flips)).alias("s2")).where(F.col("s1") < F.col("s2"))
    return near.join(s.select(F.col("sig").alias("s2")), "s2").select("s1", "s2")
