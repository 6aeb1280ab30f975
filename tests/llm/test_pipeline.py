"""The pipeline on a fixture, against a plain version of each stage."""

import random
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")


def test_pipeline(spark, tmp_path):
    from affinigraph.llm import language, queries

    from .test_text_operators import components

    rng = random.Random(4)
    sounds = {"aa": ["ka", "lu", "mo", "ti", "re"], "bb": ["sch", "ver", "ung", "ich", "wor"]}

    def prose(lang, n):
        return " ".join("".join(rng.choices(sounds[lang], k=rng.randrange(2, 6))) for _ in range(n))

    rows = [(i, prose(lang, 60), lang, f"s{i % 12}", 0) for i in range(120) for lang in [rng.choice("ab") * 2]]
    line = "all rights reserved by the owners of this site"
    rows = [(i, t + "\n" + line if i % 5 == 0 else t, lang, s, n) for i, t, lang, s, n in rows]
    item = prose("aa", 30)
    rows += [(200, rows[3][1], "aa", "s1", 0), (201, rows[4][1].replace(rows[4][1].split()[30], "new"), "aa", "s2", 0), (202, prose("aa", 40) + " " + item, "aa", "s3", 0), (203, None, None, None, 0), (204, "12 34", "aa", "s1", 0), (205, line, "aa", "s4", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = language.train(docs)
    kept = {}
    for i, t, *_ in rows:
        if t and any(c.isalpha() for c in t):
            b = t.encode()
            p = model.predict_texts(np.array([0, len(b)]), np.frombuffer(b, np.uint8))[0]
            if p.max() >= corpus_pipeline.MIN_LANGUAGE_SCORE:
                kept[i] = t
    source = {r[0]: r[3] for r in rows}
    sites, first = {}, {}
    for i, t in kept.items():
        for x in t.split("\n"):
            sites.setdefault(x.strip(), set()).add(source[i])
            first[x.strip()] = min(i, first.get(x.strip(), i))
    bad = {x for x, s in sites.items() if x and len(s) >= queries.MIN_SITES}
    assert bad == {line}
    cleaned = {i: "\n".join(x for x in t.split("\n") if x.strip() not in bad or first[x.strip()] == i) for i, t in kept.items()}
    cleaned = {i: t for i, t in cleaned.items() if t.strip()}
    assert 205 in kept and 205 not in cleaned
    unique = {i: cleaned[i] for i, x in components(list(cleaned.items())).items() if x[2]}
    assert not {200, 201} & set(unique)
    final = {i: t for i, t in unique.items() if item not in t}
    assert set(unique) - set(final) == {202}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(final)
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    for i, text in final.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        for r in got[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, columns with names of helpers; and an empty table."""
    rng = random.Random(6)
    text = [" ".join("".join(rng.choices(["ka", "lu", "mo", "ti", "re"], k=3)) for _ in range(50)) for _ in range(8)]
    item = text[7]
    rows = [(i, text[i], "aa") for i in range(4)] + [(1, text[1], "aa"), (1, text[4], "aa"), (None, text[5], "aa"), (None, text[5], "aa"), (None, text[0], "aa"), (None, text[6] + " " + item, "aa")]
    rows += [(9, "", None), (10, None, None), (11, item, "aa")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1, 2, "x", "y") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, row_ int, text_ string, h string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    firsts = [(r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.start == 0]
    assert sorted((i for i, _ in firsts), key=str) == sorted([0, 1, 2, 3, 1, None], key=str)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
