"""Driver queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .words import TERM, WORD, ascii_lowercase, ascii_uppercase


#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, window=4096)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._common import materialize, new_path
    from .warc import assemble, read_records, write_archives

    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
    page, size = F.expr("try_cast(metadata.page_id AS BIGINT)").alias("page_id"), F.octet_length("response.payload").cast("long").alias("n")
    captures = assemble(read_records(spark, path)).select(page, "capture_id", size, "response.digest", "response.record_type", "response.refers_to")
    captures = materialize(captures, "captures")
    first = captures.where(F.col("record_type") == "response")
    names = ["page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type"]
    own = first.select(*names, F.lit(None).cast("long").alias("refers_to"))
    told = first.select(F.col("capture_id").alias("of_"), F.col("page_id").alias("of_page"), "n")
    again = captures.where(F.col("record_type") == "revisit").drop("n").join(told, F.col("refers_to") == F.col("of_"), "left")
    return own.unionByName(again.select(*names, F.col("of_page").alias("refers_to")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import remove_boilerplate

    cleaned = remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=MIN_SITES)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import section_counts

    return section_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .privacy import KINDS, joined, sanitise

    out = sanitise(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    hashed = lambda c, name: F.sha2(c, 256).alias(name)
    clean = hashed(F.coalesce("clean_text", F.lit("")), "clean_sha256")
    return out.select("doc_id", *(count(k) for k in KINDS), hashed(joined(F.col("base")), "base_sha256"), joined(F.col("spans")).alias("spans"), clean)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    named = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return identify(named, train(docs), keep=("doc_id", "held_out"))


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_products import top_products

    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, longest=1, buckets=10_000, min_words=20, seed=2024)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"), min_docs=3, top_terms=200)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": WARC_SQL, "op4_line_dedup": LINES_SQL, "op11_exact_search": TOP_SQL, "op12_resampling": RESAMPLING_SQL,
        "op13_source_divergence": DIVERGENCE_SQL,
    }


# SHA-1 in base32: as in the operator, 20 bits give 4 letters
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS x FROM p),
b AS (SELECT page_id, n, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, 1 + 5 * i, 5) AS BIGINT) >> (15 - 5 * j)) & 31 AS INTEGER) + 1, 1), '' ORDER BY i, j)
      FROM range(8) a(i), range(4) c(j)) AS digest FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM b WINDOW w AS (PARTITION BY digest)
"""

LINES_SQL = f"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
bad AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES}),
r AS (SELECT k.doc_id, count(*) AS n, count(bad.key) FILTER (k.doc_id <> first_doc) AS gone,
      string_agg(line, chr(10) ORDER BY pos) FILTER (bad.key IS NULL OR k.doc_id = first_doc) AS kept
      FROM k LEFT JOIN bad ON k.key = bad.key GROUP BY k.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN r USING (doc_id)
"""

TOP_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS query_id, b.id AS vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

# CRC-32 by its rule: a table of all bytes, and a fold over the bytes of each distinct word
RESAMPLING_SQL = f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS tab FROM range(256) t(b)),
w AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}') AS ws FROM documents),
x AS (SELECT r, unnest(ws) AS word FROM w),
y AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}')) AS word FROM benchmark),
u AS (SELECT DISTINCT word FROM (SELECT word FROM x UNION ALL SELECT word FROM y)),
z AS (SELECT word, list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT))) AS bs FROM u),
h AS (SELECT word, xor(list_reduce(bs, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM z, tab),
s AS (SELECT b, count(*) AS n FROM x JOIN h USING (word) GROUP BY b), t AS (SELECT b, count(*) AS n FROM y JOIN h USING (word) GROUP BY b),
g AS (SELECT range AS b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM x) + 10000) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM y) + 10000)))) AS BIGINT) AS gain
  FROM range(10000) LEFT JOIN s ON s.b = range LEFT JOIN t ON t.b = range),
d AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM x JOIN h USING (word) JOIN g USING (b) GROUP BY r),
e AS (SELECT doc_id, r, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
  CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d USING (r)),
f AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score, n_features >= 20 AS enough FROM e),
k AS (SELECT *, CASE WHEN enough THEN row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) END AS place FROM f)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM f WHERE enough) // 100 THEN place END AS rank FROM k
"""

DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tok AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, '{ascii_uppercase}', '{ascii_lowercase}'), '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
size AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT lang, source, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) s),
sh AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + z.v) AS BIGINT) AS p
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN size z ON z.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (z.total + z.v) AS BIGINT) AS q FROM kept k JOIN size z USING (lang)),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p)::HUGEINT * (a.p - b.p)) // b.p) AS f FROM sh a JOIN sh b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q)::HUGEINT * (p - q)) // q AS BIGINT) AS value FROM sh JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
