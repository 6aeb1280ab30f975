"""Removal of cross-site boilerplate lines by their spread over distinct sites.

HyperLogLog sketches of the sites of each line merge by aggregation. Lines whose estimate is close to the threshold get an
exact distinct count. A line on at least ``min_sites`` sites is boilerplate: it stays in the document with the smallest id
that has it and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import as_struct, from_struct, joined_by, materialize
from .words import bound

BLANKS = " \t\r"


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def line_table(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """One row for each distinct non-blank line of each row: its hash, site, document and the text's hash."""
    hashes = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), line_hash))
    return docs.select(F.col(key).cast("long").alias("doc_"), F.xxhash64(text).alias("text_"), F.col(site).alias("site_"), F.explode(hashes).alias("h"))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 12, margin: float = 0.1) -> DataFrame:
    """(h, first_): hashes of lines on at least ``min_sites`` sites, and the smallest document that has each.

    A line on so many sites occurs as often, so sketches are built only for lines that do. Aggregates combine a hot line's
    rows before each shuffle, and joins back to the lines send a small table or salt a large one.
    """
    often = materialize(lines.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h"), "often")
    placed = lines.where(F.col("site_").isNotNull())
    spread = (
        joined_by(placed, often, ["h"], F.col("doc_"), "left_semi")
        .groupBy("h").agg(F.hll_sketch_agg("site_", lg_k).alias("sketch"))
        .select("h", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    spread = materialize(spread.where(F.col("sites") >= int(min_sites * (1 - margin))), "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + margin) + 1).select("h")
    exact = joined_by(placed, near, ["h"], F.col("doc_"), "left_semi").select("h", "site_").distinct().groupBy("h").agg(F.count("*").alias("exact"))
    bad = materialize(spread.join(exact, "h", "left").where(F.coalesce("exact", "sites") >= min_sites).select("h"), "bad")
    return joined_by(lines, bad, ["h"], F.col("doc_"), "left_semi").groupBy("h").agg(F.min("doc_").alias("first_"))


def in_sorted(x: Column, values: Column, steps: Column) -> Column:
    """Whether an ascending array has x, by halving: ``steps`` are the powers of two up to its size, falling."""
    below = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(values, at + s - 1) <= x, at + s).otherwise(at))
    return bound(below, lambda at: (at > 0) & F.coalesce(F.get(values, at - 1) == x, F.lit(False)))


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with the remaining text, and ``n_lines``, ``n_removed`` (in place of columns so named).

    Lines are compared without blanks at their ends; blank lines never count as boilerplate. A null site is no site. A null
    text stays null, with no lines. Repeated rows keep or lose the same lines; among ids, a null comes last. Lines and texts
    are known by 64-bit hashes: of n distinct lines about n ** 2 / 2 ** 65 pairs agree by chance (one in 10 ** 10 lines).
    """
    lines = materialize(line_table(docs, key, text, site), "lines")
    bad = materialize(boilerplate(lines, min_sites), "boilerplate")
    drop = joined_by(lines, bad, ["h"], F.col("doc_")).where(~F.col("doc_").eqNullSafe(F.col("first_"))).groupBy("doc_", "text_").agg(F.sort_array(F.collect_set("h")).alias("drop_"))
    falling = F.transform(F.sequence(F.floor(F.log2(F.size("drop_"))).cast("int"), F.lit(0)), lambda b: F.pow(F.lit(2), b).cast("int"))
    drop = drop.withColumn("steps_", falling)
    rows = docs.select(as_struct(docs), F.col(key).cast("long").alias("key_"), F.xxhash64(text).alias("hash_"))
    joined = rows.join(drop, F.col("key_").eqNullSafe(F.col("doc_")) & (F.col("hash_") == F.col("text_")), "left")
    split = F.split(F.col("row_")[text], "\n")
    stays = lambda x: (F.btrim(x, F.lit(BLANKS)) == "") | bound(line_hash(x), lambda h: ~in_sorted(h, F.col("drop_"), F.col("steps_")))
    kept = F.when(F.col("drop_").isNull(), split).otherwise(F.filter(split, stays))
    new = {
        "n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size(split) - F.size("kept_"), F.lit(0)).cast("long"),
        text: F.array_join("kept_", "\n"),
    }
    return from_struct(joined.withColumn("kept_", kept), docs.columns, new)
