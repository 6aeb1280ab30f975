"""Audit of how the sources of a language diverge in their words, in plain relational steps.

Matches of the term pattern are exploded and counted by language, source and term. Every source meets every kept term of its
language, so that a term which it lacks has its smoothed share too. Joining that table with itself on language and term
pairs the sources, and a sum over terms gives their divergence; a window ranks it. A second part ranks the terms that a
source has more of than its language.

Shares are whole billionths, and every step is integer arithmetic, so results don't depend on the order of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import is_small, joined_by, materialize
from .words import TERM, bound, words


def term_counts(docs: DataFrame, text: str, lang: str, source: str, pattern: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term. Sorted terms of a document tell the first
    of each, so one pass counts both, and tasks add up before the shuffle."""
    first = lambda ws: lambda w, i: F.struct(w.alias("term"), ((i == 0) | (F.get(ws, i - 1) != w)).alias("first"))
    marked = bound(F.sort_array(words(F.col(text), pattern)), lambda ws: F.transform(ws, first(ws)))
    each = docs.select(lang, source, F.explode(marked).alias("x"))
    return each.groupBy(lang, source, F.col("x.term").alias("term")).agg(F.count("*").alias("n"), F.sum(F.col("x.first").cast("long")).alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10 ** 9 (n + 1) / (total + kept)), exact for counts up to 10 ** 20."""
    return F.expr(f"1 + (CAST({n} + 1 AS DECIMAL(20,0)) * 1000000000BD) div CAST({total} + {kept} AS DECIMAL(20,0))")


#: Below 10 ** 18 + 2 * 10 ** 9, as shares are at most 10 ** 9 + 1 and at least 1; sums over terms stay below 2 ** 63.
GAIN = "((p - q) * (p - q)) div q"


def audit(
    docs: DataFrame, min_docs: int = 3, top_terms: int = 200, text: str = "text", lang: str = "lang", source: str = "source", pattern: str = TERM,
) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: every other source of the language, by how far this one's shares
    are from its; part ``term``: the ``top_terms`` kept terms that tell the source from its language.

    Null texts, languages and sources count as empty ones, which are a language and a source like others. Each row is a
    document, repeated ones too. A source without terms has the smoothed shares; without kept terms its pairs have value 0.
    Ties go to the smaller item by UTF-8 bytes. An empty table has no groups. Other columns are ignored.
    """
    d = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))))
    counts = term_counts(d, "text", "lang", "source", pattern)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    kept = kept.where(F.col("docs") >= min_docs).select(F.monotonically_increasing_id().alias("t"), "lang", "term", "n", F.map_from_entries("held").alias("held"))
    kept = materialize(kept, "kept_terms")  # t is a number for language and term
    sizes = materialize(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total")), "languages")
    here = kept.select("lang", "term", "n", F.explode("held").alias("source", "own"))
    totals = here.groupBy("lang", "source").agg(F.sum("own").alias("total"))
    groups = d.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes.select("lang", "kept"), "lang", "left")
    groups = groups.select(F.monotonically_increasing_id().alias("g"), "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    groups = materialize(groups, "groups")  # g is a number for language and source

    few = is_small(groups)
    spread = joined_by(kept.select("t", "lang", "held"), groups, ["lang"], F.col("t"), small=few)
    spread = spread.withColumn("own", F.coalesce(F.element_at("held", F.col("source")), F.lit(0).cast("long")))
    dense = materialize(spread.select("t", "g", share("own", "total", "kept").alias("p")), "shares")
    apart = dense.join(dense.select("t", F.col("g").alias("h"), F.col("p").alias("q")), "t").where(F.col("g") != F.col("h"))
    apart = apart.groupBy("g", "h").agg(F.sum(F.expr(GAIN)).alias("value"))
    own = groups.select("g", "lang", "source")
    pairs = own.join(own.select(F.col("g").alias("h"), "lang", F.col("source").alias("item")), "lang").where(F.col("g") != F.col("h"))
    pairs = pairs.join(apart, ["g", "h"], "left").withColumn("value", F.coalesce("value", F.lit(0)))

    told = joined_by(here, groups.drop("g"), ["lang", "source"], F.col("term"), small=few).withColumn("p", share("own", "total", "kept")).drop("total")
    told = joined_by(told, sizes.select("lang", "total"), ["lang"], F.col("term"), small=few).withColumn("q", share("n", "total", "kept"))
    told = told.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), F.expr(GAIN).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(told, "term").where(F.col("rank") <= top_terms))
