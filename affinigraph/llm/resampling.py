"""Importance resampling of documents towards a target text: hashed words, explode-free scoring, Gumbel draws.

Higher-order functions turn each text into the array of its features' buckets, once; it is written. Buckets are counted over
all documents and over the target, and only these totals, one number for each bucket, meet anywhere. The log ratio of the two
shares is a literal array; a document's weight is an aggregate over its own array that looks each bucket up there. A draw
by weight without replacement is the largest sums of weight and Gumbel noise, which a hash of the document's id makes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize
from .words import WORD, bound, words

SCORED = "doc_id long, n_features long, weight long, score long, rank long"


def bucket_arrays(docs: DataFrame, text: str, longest: int, buckets: int) -> tuple[Column, Column]:
    """Columns: the number of words, and the bucket of each run of 1 to ``longest`` words by the CRC-32 of its bytes."""
    found = words(F.col(text), WORD)
    kind = "smallint" if buckets <= 1 << 15 else "int"
    bucket = lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast(kind)
    if longest == 1:
        return F.size(found), F.transform(found, bucket)

    def runs(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(w, i, F.lit(n)), " ")))

    return F.size(found), bound(found, lambda w: F.concat(*(runs(w, n) for n in range(1, longest + 1))))


def bucket_counts(rows: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs in the arrays ``b``: a number for each bucket, added up by the tasks first."""
    out = [0] * buckets
    for r in rows.select(F.explode("b").alias("b")).groupBy("b").count().collect():
        out[r.b] = r["count"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln) of each bucket's share in the target over that in the source, both with one more in each bucket."""
    s, t, n = float(sum(source)), float(sum(target)), len(source)
    return [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source, target, strict=True)]


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 2024,
    key: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; ranks from 1 for the ``percent`` drawn of those with
    ``min_words`` words or more, null for all others. Ties go to smaller ids.

    A null or empty text has no features and weight 0. A row without an id gets the noise of an empty one, and comes last of
    equal scores; rows that share an id share its noise, and each is a document. Empty tables give no rows; an empty target
    has equal shares. Other columns are ignored.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent lies between 0 and 100")
    n_words, b = bucket_arrays(docs, text, longest, buckets)
    rows = materialize(docs.select(F.col(key).cast("long").alias("doc_id"), n_words.alias("n_words"), b.alias("b")), "buckets")
    wanted = target.select(bucket_arrays(target, target_text, longest, buckets)[1].alias("b"))
    gain = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets))
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # a constant for the optimizer

    total = F.aggregate("b", F.lit(0).cast("long"), lambda acc, x: acc + F.element_at(table, x.cast("int") + 1))
    summed = rows.select("doc_id", "n_words", F.size("b").cast("long").alias("n_features"), total.alias("total"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    scored = summed.select("doc_id", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise)
    scored = materialize(scored, "scored")

    # A row for each score: weights and noise stay within some 60,000 of 0 for any counts, so the table is bounded.
    enough = F.col("n_words") >= min_words
    by_score = sorted(((r.score, r["count"]) for r in scored.where(enough).groupBy("score").count().collect()), reverse=True)
    draw = percent * sum(n for _, n in by_score) // 100
    before, ahead = 0, []
    for score, n in by_score:
        if before >= draw:
            break
        ahead.append((score, before))
        before += n
    out = [F.col(c).cast("long").alias(c) for c in ("doc_id", "n_features", "weight", "score")]
    if not ahead:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    offsets = scored.sparkSession.createDataFrame(ahead, "score long, ahead long")
    near = enough & (F.col("score") >= ahead[-1][0])
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight"))
    drawn = scored.where(near).withColumn("place", place).join(F.broadcast(offsets), "score").withColumn("rank", F.col("ahead") + F.col("place"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")).cast("long"))
    return drawn.select(*out, "rank").unionByName(scored.where(~near).select(*out, F.lit(None).cast("long").alias("rank")))
