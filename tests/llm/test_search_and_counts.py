"""Exact search, resampling and source divergence against plain Python, over odd rows and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest


def exact_top(rows, is_query, k, scale=1024):
    """Of (id, vector) rows: (query, rank, id, score), with Python's unbounded integers."""
    fine = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    floor = lambda x: math.floor(x * scale) if abs(x) < 2.0**40 else int(x) * scale
    whole = [(i, [floor(x) for x in v]) for i, v in fine]
    asks = {}
    for i, v in fine:
        if is_query(i):
            asks[i] = min(asks.get(i, v), v)
    out = []
    for i, v in asks.items():
        q = [floor(x) for x in v]
        near = sorted((-min(max(sum(a * b for a, b in zip(q, w, strict=False)), -(2**63)), 2**63 - 1), j) for j, w in whole if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def searched(spark, rows, k=10):
    from pyspark.sql import functions as F

    from affinigraph.llm.top_products import top_products

    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, v int, block string").repartition(7)
    return sorted(tuple(r) for r in top_products(df, F.col("vec_id") % 10 == 0, k=k).collect())


def test_top_products(spark, monkeypatch):
    """Many shards, ties, repeated vectors and ids, odd vectors."""
    from affinigraph.llm import top_products as m

    monkeypatch.setattr(m, "SHARD_BYTES", 400)  # so that lists are merged in several rounds
    monkeypatch.setattr(m, "CHUNK", 4)
    monkeypatch.setattr(m, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(150)] + [(2000 + i, [0.5] * 5) for i in range(40)] + rows[:12]
    rows += [(30, [9.0] * 5), (None, [9.0] * 5), (3010, None), (3020, [1.0, None, 1.0, 1.0, 1.0]), (3030, [float("nan")] * 5), (3031, [float("inf")] * 5), (3040, []), (3050, [1.0, -1.0]), (3051, [2.0] * 9)]
    assert searched(spark, rows) == exact_top(rows, lambda i: i % 10 == 0, 10)
    assert searched(spark, rows[:3], 5) == exact_top(rows[:3], lambda i: i % 10 == 0, 5)
    assert searched(spark, []) == [] and searched(spark, [(1, [1.0])]) == []


@pytest.mark.parametrize("size", [1e4, 1e9, 1e15, 1e300])
def test_top_products_of_large_values(spark, size):
    """Values beyond doubles' whole numbers, and beyond 64 bits."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * size).tolist()) for i in range(30)] + [(40, [1.5, 0.0, -0.001]), (50, [-0.0, 0.25, 1e-300])]
    assert searched(spark, rows, 4) == exact_top(rows, lambda i: i % 10 == 0, 4)


def plain_words(text, letters_only=False):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+" if letters_only else r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_resample(rows, target, percent, longest, buckets, min_words, seed):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in rows for b in features(x)), Counter(b for x in target for b in features(x))
    n_s, n_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x)) >= min_words])
    enough = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for n, r in enumerate(enough[: percent * len(enough) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


TEXTS = ["The cat sat. THE Cat!", None, "", "\x00\x01 -- ?", "naïve Ünïcode Ä ä 中文 9 lives x \U0001f600", "a " * 40_000, "KK İ \x7f b", "one two three four five", "cat " * 7]


@pytest.mark.parametrize("longest, percent", [(1, 30), (2, 50), (1, 0), (1, 100)])
def test_resample(spark, longest, percent):
    from affinigraph.llm.resampling import resample

    rows = list(enumerate(TEXTS)) + [(100 + i, f"word{i % 7} cat the x{i} y") for i in range(60)] + [(100, "word0 cat the x0 y"), (None, "the cat sat on it"), (None, "no")]
    target = ["the cat and the cat", None, "word3 Word4"]
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id long, text string, b int, score int").repartition(5)
    texts = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample(docs, texts, percent, longest, 50, 3, 7)
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(rows, target, percent, longest, 50, 3, 7)
    assert resample(docs.limit(0), texts, percent, longest).count() == 0
    none = resample(docs, texts.limit(0), percent, longest, 50, 3, 7)
    assert sorted((tuple(r) for r in none.collect()), key=str) == plain_resample(rows, [], percent, longest, 50, 3, 7)


def plain_audit(rows, min_docs, top):
    rows = [(plain_words(t, True), lang or "", source or "") for t, lang, source in rows]
    seen, out = {}, []
    for words, lang, _ in rows:
        seen.setdefault(lang, Counter()).update(set(words))
    for lang, docs in seen.items():
        kept = sorted((w for w, n in docs.items() if n >= min_docs), key=lambda w: w.encode())
        count = {}
        for words, own, source in rows:
            if own == lang:
                count.setdefault(source, Counter()).update(w for w in words if w in set(kept))
        share = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in p if o != s)
            terms = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, x[2], -x[0], n + 1) for part, found in (("pair", pairs), ("term", terms)) for n, x in enumerate(found)]
    return sorted(out)


def test_divergence(spark):
    from affinigraph.llm.divergence import audit

    rng = np.random.default_rng(3)
    names = ["alpha", "beta", "Gamma", "dé", "中文", "zz", "o'k", "a1b2"]
    rows = [(" ".join(rng.choice(names, rng.integers(0, 9))), ["en", "de", None][rng.integers(3)], [f"s{rng.integers(4)}", "hot", "hot", None][rng.integers(4)]) for _ in range(150)]
    rows += rows[:20] + [(t, "en", "odd") for t in TEXTS] + [(None, "xx", "a"), ("only once", "xx", "b"), ("", "yy", ""), ("word", "", "empty"), ("Word", "", "empty"), ("WORD", None, "empty")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, n int").repartition(5)
    got = audit(docs, 3, 4)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, 3, 4)
    assert audit(docs.limit(0)).count() == 0


def test_divergence_without_sent_tables(spark, monkeypatch):
    """The same where tables of groups are too large to send."""
    from affinigraph.llm import divergence

    docs = spark.createDataFrame([(f"a b c{i % 3}", "en", f"s{i % 4}") for i in range(40)], "text string, lang string, source string")
    want = sorted(tuple(r) for r in divergence.audit(docs).collect())
    monkeypatch.setattr(divergence, "is_small", lambda df: False)
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == want


def test_documents_of_many_boilerplate_lines(spark):
    """20,000 lines that all go, in each of ten documents, among lines that stay: work follows the lines."""
    import time

    from affinigraph.llm.lines import remove_boilerplate

    common = [f"line number {i} of the license" for i in range(20_000)]
    rows = [(i, "\n".join([f"own {i}", *common, "", f"end {i}"]), f"s{i}") for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    began = time.perf_counter()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in remove_boilerplate(docs, 10).collect()}
    assert got[0] == (20_003, 0, rows[0][1])
    assert all(got[i] == (20_003, 20_000, f"own {i}\n\nend {i}") for i in range(1, 11))
    assert time.perf_counter() - began < 100
