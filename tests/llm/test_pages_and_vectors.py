import base64
import hashlib

import numpy as np
import pytest

from affinigraph.llm._common import new_path


def test_warc_round_trip(spark):
    from affinigraph.llm.warc import assemble, read_records, write_archives

    html = ["<p>one</p>", "", None, "two\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "<p>one</p>", "é" * 5000, "<p>one</p>", ""]
    rows = [(i, f"https://h.example/{i}?q=1#f" if i != 3 else None, h, "x") for i, h in enumerate(html)] + [(6, "https://h.example/6", "<p>one</p>", "x"), (9, "http://a/\r\nX: y", "z", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, url_ string")
    path = new_path(spark, "warc")
    write_archives(pages, path, file_bytes=1 << 12)
    every = assemble(read_records(spark, path)).collect()
    got = {int(r.metadata.page_id): r for r in every}
    bodies = {i: (h or "").encode() for i, _, h, _ in rows}
    assert set(got) == set(bodies) and len(every) == len(rows)
    assert sorted(r.response.record_type for r in every if r.metadata.page_id == "6") == ["response"] * 2
    responses = {r.capture_id: int(r.metadata.page_id) for r in every if r.response.record_type == "response"}
    for r in every:
        i = int(r.metadata.page_id)
        b = bodies[i]
        winner = max(k for k, x in bodies.items() if x == b)
        assert r.response.digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert r.request is not None and r.request.uri == r.response.uri
        if i == winner:
            assert r.response.record_type == "response" and bytes(r.response.payload) == b and r.response.refers_to is None
        else:
            assert r.response.record_type == "revisit" and responses[r.response.refers_to] == winner and bytes(r.response.payload) == b""
    assert got[9].response.uri == "http://a/%0D%0AX: y"
    path = new_path(spark, "warc")
    write_archives(pages, path, min_bytes=1)
    kinds = {int(r.metadata.page_id): r.response.record_type for r in assemble(read_records(spark, path)).collect()}
    assert [kinds[i] for i in (1, 2, 7)] == ["response"] * 3 and kinds[0] == "revisit"


def test_warc_query_keeps_every_row(spark, tmp_path):
    """One row for each page: null and repeated ids, null and very long payloads; an empty table has none."""
    from affinigraph.llm.queries import op3_warc

    long = "word " * 1_000_000
    rows = [(1, "http://a/", "x"), (None, "http://a/", "x"), (2, None, None), (2, None, None), (None, "http://b/", "only"), (None, "http://b/", "only"), (3, "http://c/", long), (4, "http://c/", long)]
    table = spark.createDataFrame([(*r, "y", 1) for r in rows], "page_id long, url string, html string, body_ string, row_ int")
    table.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in op3_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([
        (1, 1, "response", None), (None, 1, "revisit", 1), (2, 0, "response", None), (2, 0, "response", None),
        (None, 4, "response", None), (None, 4, "response", None), (3, len(long), "revisit", 4), (4, len(long), "response", None),
    ], key=str)
    table.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    assert op3_warc(spark, str(tmp_path)).count() == 0


def test_warc_damage():
    from affinigraph.llm.warc import parse

    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n" % len(block)
    assert next(parse(good + b"\r\n" + block + b"\r\n\r\n"))[-1] == b"body"
    for bad in (good + b"\r\n" + block[:-2], b"junk\r\n\r\n", good + b"WARC-Payload-Digest: sha1:AAAA\r\n\r\n" + block + b"\r\n\r\n"):
        with pytest.raises(ValueError):
            list(parse(bad))


def brute(vectors, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    n = np.sqrt((x * x).sum(1))
    out = {}
    for i in ids[ids % 50 == 0]:
        q = x[ids == i][0]
        s = (x * q).sum(1) / (np.sqrt((q * q).sum()) * n)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_nearest_neighbours(spark):
    from pyspark.sql import functions as F

    from affinigraph.llm.neighbours import nearest

    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=16) for i in range(1, 1500)}
    for i in range(0, 1500, 3):
        vectors[i] = np.ones(16)  # a third of the rows are one vector
    for i in range(50, 1500, 150):
        vectors[i] = vectors[i + 1] * 3 + 0.01
    rows = [(i, v.tolist(), "x") for i, v in vectors.items()] + [(2000, None, "x"), (2050, [0.0] * 16, "x"), (2001, [float("nan")] + [1.0] * 15, "x"), (2002, [1.0] * 3, "x"), (2003, [None] + [1.0] * 15, "x"), (None, [1.0] * 16, "x"), (2004, [float("inf")] + [1.0] * 15, "x"), (7, [9.0] * 16, "x")]
    vectors[7] = np.minimum(vectors[7], 9.0) if vectors[7].tolist() < [9.0] * 16 else np.full(16, 9.0)
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, raw string")
    got = {}
    for r in nearest(t, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(vectors, 5)
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        assert [x[0] for x in found] == [1, 2, 3, 4, 5]
        for a, b in zip(found, found[1:], strict=False):
            assert (-a[2], a[1]) < (-b[2], b[1])
        hit += len({x[1] for x in found} & {x[0] for x in want[q]})
    assert hit >= 0.9 * 5 * len(want)
    assert [x[1] for x in got[0]] == [3, 6, 9, 12, 15]
    few = nearest(t.where("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2 and nearest(t.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("kind", ["heaps", "clusters", "lines"])
def test_nearest_neighbours_of_uneven_vectors(spark, kind):
    """Heaps of equal vectors with queries far from all, tight clusters, and vectors along few directions: every query has its
    five rows, and at least nine of ten are true."""
    from pyspark.sql import functions as F

    from affinigraph.llm.neighbours import nearest

    rng = np.random.default_rng(9)
    if kind == "heaps":
        heaps = rng.normal(size=(8, 24))
        x = heaps[rng.integers(0, 8, 3000)]
        x[::50][: len(x) // 50 - 1] = rng.normal(size=(len(x) // 50 - 1, 24))
    elif kind == "clusters":
        x = rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 24))
    else:
        x = rng.normal(size=(3000, 3)) @ rng.normal(size=(3, 24)) + 0.01 * rng.normal(size=(3000, 24))
    vectors = dict(enumerate(x))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(t, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(vectors, 5)
    assert {q: len(v) for q, v in got.items()} == dict.fromkeys(want, 5)
    hit = sum(len({a for a, _ in got[q]} & {x[0] for x in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want), hit / 5 / len(want)
    for q, found in got.items():
        np.testing.assert_allclose([s for _, s in found], [vectors[q] @ vectors[i] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[i]) for i, _ in found], atol=1e-12)
