"""A training corpus from ``documents``: five stages, each written as Parquet and read again for the next.

Columns other than the table's own are ignored. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinigraph.llm import decontaminate, language, lines, near_duplicates, packing, queries
from affinigraph.llm._common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose language is less certain is rejected.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter whose language is recognised. The network learns from the labelled ones; without any,
    or without documents, none is kept. Null and empty texts go; repeated rows stay or go alike; ids may be null."""
    rest = tuple(c for c in COLUMNS if c != "text")
    named = language.identify(docs.select(*COLUMNS), language.train(docs), keep=rest, keep_text=True)
    return named.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def remove_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site lines out of all documents but the first; documents of such lines alone go. ``n_chars`` follows a
    changed text. Repeated rows lose the same lines; among ids, a null comes last; a null source is no site."""
    out = lines.remove_boilerplate(docs.select(*COLUMNS), min_sites=queries.MIN_SITES)
    left = (F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")) & F.col("text").rlike(r"\S")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(left).withColumn("n_chars", changed).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that with the smallest id, of each component of near duplicates. Each row is judged by its own text:
    repeated rows leave one, a null id comes last, and a text without words stays."""
    return near_duplicates.drop_near_duplicates(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item; each row is judged by its own text, and a null text stays."""
    return decontaminate.drop_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows of the concatenated tokens. A null or empty text is one end id; repeated rows are packed each."""
    return packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), end_id=2, window=4096)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_boilerplate_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack_tokens),
]

#: Training, sketches and alignment have no SQL form; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
