"""The registered queries themselves, over small tables with odd rows, and over empty ones."""

import pytest

queries = pytest.importorskip("affinigraph.llm.queries")
pytest.importorskip("public_tokenizers")

#: Columns that each query must have, and their types.
COLUMNS = {
    "op1_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op2_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op4_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string",
    "op5_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6_token_counts": "doc_id bigint, section int, n_tokens bigint, n_crossing bigint",
    "op7_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op8_privacy": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9_decontamination": "doc_id bigint, item_id bigint",
    "op10_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_exact_search": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op12_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    line = "seven words that make up one line"
    texts = [line, line, None, "", "x", "mail me@a.org or 10.0.0.1\n" + line, "ab " * 60_000, (line + "\n") * 40, line.upper(), "中文 é"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i}", 1, "clash", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_ string, row_ int")
    pages = spark.createDataFrame([(i, f"http://a/{i}", t, "x") for i, t in enumerate(texts)], "page_id long, url string, html string, body_ string")
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i % 2)], 1) for i in range(12)] + [(50, None, 1), (100, [0.0] * 3, 1)], "vec_id long, embedding array<float>, label int")
    for name, df in (("documents", docs), ("pages", pages), ("embeddings", vectors), ("benchmark", spark.createDataFrame([(1, line), (2, None)], "item_id long, text string"))):
        df.write.parquet(f"{d}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{d}/none/{name}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, folder, name):
    df = queries.queries()[name](spark, f"{folder}/full")
    have = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        c, t = column.split()
        assert have[c] == t, column
    rows = df.collect()
    if name in ("op1_suffix_dedup", "op4_line_dedup", "op5_near_duplicates", "op8_privacy", "op10_language", "op12_resampling"):
        assert sorted(r.doc_id for r in rows) == list(range(10))
    if name == "op3_warc":
        assert sorted(r.page_id for r in rows) == list(range(10))
    if name == "op2_packing":
        assert {r.doc_id for r in rows} == set(range(10)) and sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    if name == "op7_nearest_neighbours":
        assert [(r.query_id, r.rank) for r in sorted(rows, key=lambda r: r.rank)] == [(0, k) for k in range(1, 6)]
    if name == "op11_exact_search":
        assert [(r.query_id, r.rank) for r in sorted(rows, key=lambda r: (r.query_id, r.rank))] == [(q, k) for q in (0, 100) for k in range(1, 11)]
    if name == "op13_source_divergence":
        assert {(r.lang, r.source) for r in rows if r.part == "pair"} == {("en" if i % 2 else "", f"s{i}") for i in range(10)}
    if name == "op9_decontamination":
        assert {r.doc_id for r in rows} == {0, 1, 5, 7, 8}
    assert queries.queries()[name](spark, f"{folder}/none").count() == 0
