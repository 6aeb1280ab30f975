"""The vector operators against numpy and hand-worked fixtures."""

import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from affinigraph.functions import vectors as fv
from affinigraph.operators import bounds, buckets, clustering, eigen, graph, landmarks, metrics, neighbours, sparse
from affinigraph.plans import catalogue, pipelines
from affinigraph.sources import datagen, points, store

from fixtures import NINE, NINE_GROUPS, PSEUDO, PSEUDO_GROUPS

# A published fixture of numeric rows.
SINGLE = [
    [1.0, 2.0, 6.0, 1.0, 2.0, 6.0], [1.0, 3.0, 0.0, 1.0, 3.0, 0.0], [1.0, 4.0, 6.0, 1.0, 4.0, 6.0], [1.3, 2.2, 6.4, 2.1, 2.3, 1.0], [1.2, 3.0, 0.0, 1.0, 3.0, 0.0],
    [1.1, 4.0, 6.2, 4.0, 4.0, 6.3], [1.4, 2.5, 6.5, 1.2, 2.0, 6.2], [1.5, 2.1, 0.6, 2.0, 3.0, 0.7], [1.1, 4.6, 7.0, 1.5, 2.1, 6.0],
]


@pytest.fixture(scope="module")
def nine(spark):
    return points.from_rows(spark, NINE).cache()


def rows_of(df, key, *cols):
    return {getattr(r, key): tuple(r[c] for c in cols) for r in df.collect()}


def grouping(assigned):
    g = {}
    for r in assigned.collect():
        g.setdefault(r.cluster, set()).add(r.id)
    return sorted(map(sorted, g.values()))


def test_nearest_neighbour_goldens(nine):
    near = neighbours.neighbours(nine, 4)
    order = {}
    for r in near.orderBy("i", "rank").collect():
        order.setdefault(r.i, []).append(r.j)
    assert order == {0: [0, 2, 1, 3], 1: [1, 3, 0, 2], 2: [2, 0, 1, 3], 3: [3, 1, 0, 2], 4: [4, 7, 6, 5], 5: [5, 6, 8, 7], 6: [6, 8, 5, 7], 7: [7, 4, 6, 5], 8: [8, 6, 5, 7]}
    assert graph.both_ways(near).count() == 72 and graph.symmetric_edges(near).count() == 39
    means = rows_of(graph.mean_distances(near), "i", "mean")
    np.testing.assert_allclose([means[i][0] for i in range(9)], [178.9406, 180.8206, 183.3469, 181.3656, 6.3417, 6.5322, 5.4111, 6.4300, 5.1471], atol=1e-4)
    w = graph.graph_matrix(graph.self_tuned_affinity(near)).collect()
    m = np.zeros((9, 9))
    for r in w:
        m[r.i, r.j] = r.w
    assert np.allclose(m, m.T)
    np.testing.assert_allclose(np.sort(np.abs(np.linalg.eigvalsh(m)))[::-1][:4], [4.1487, 3.9986, 3.9748, 3.2946], atol=1e-4)


def test_blocks_agree_with_pairs(nine):
    a = {(r.i, r.j, r.rank) for r in neighbours.neighbours(nine, 4).collect()}
    assert a == {(r.i, r.j, r.rank) for r in neighbours.neighbours(nine, 4, block=2).collect()}
    own = nine.withColumn("bucket", F.when(F.col("id") < 4, 5).otherwise(7))
    b = {(r.i, r.j, r.rank) for r in neighbours.bucket_neighbours(own, 3).collect()}
    assert b == {(r.i, r.j, r.rank) for r in neighbours.bucket_neighbours(own, 3, small=0, block=2).collect()}


def test_all_pairs(nine):
    x = np.array(NINE)
    want = ((x[:, None] - x[None]) ** 2).sum(2)
    for block in (100, 2):
        got = {(r.i, r.j): r.d for r in neighbours.all_pairs(nine, block=block).collect()}
        assert len(got) == 81 and all(math.isclose(v, want[k], abs_tol=1e-9) for k, v in got.items())


def test_bucket_goldens(nine, spark):
    np.testing.assert_allclose(fv.java_doubles(3, 4), [0.731057369149, 0.070992034752, 0.067120009390, 0.768156984078], atol=1e-12)
    bits = buckets.fit_hash(nine)
    got = rows_of(bits, "bit", "pos", "threshold")
    assert [got[b][0] for b in range(20)] == [4, 0, 0, 4, 1, 4, 4, 0, 4, 5, 1, 5, 5, 3, 5, 1, 3, 0, 2, 2]
    level = {p: t for p, t in got.values()}
    np.testing.assert_allclose([level[p] for p in range(6)], [4.38, 11.25, 4.13, 5.25, 10.5, 0.955], atol=1e-9)
    signed = buckets.signatures(nine, bits)
    sig = {r.id: r.sig for r in signed.collect()}
    assert [sig[i] for i in (0, 2, 1, 3)] == [0, 0, 809472, 809472] and {sig[i] for i in range(4, 9)} == {1048575}
    assert grouping(buckets.buckets(signed).withColumnRenamed("bucket", "cluster")) == [[0, 2], [1, 3], [4, 5, 6, 7, 8]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 255), unique=True, max_size=20))
def test_greedy_buckets(sigs):
    left, want, n = list(sigs), {}, 0
    while left:
        head = left[0]
        own = [s for s in left if bin(s ^ head).count("1") <= 1]
        want |= dict.fromkeys(own, n)
        left, n = [s for s in left if s not in own], n + 1
    assert dict(buckets.lead_signatures([(s, i) for i, s in enumerate(sigs)])) == want


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(0, 2), min_size=1, max_size=20))
def test_bins(spark, xs):
    df = spark.createDataFrame([(x,) for x in [*xs, 0.0, 0.1, 0.2, 2.0, 2.05, 9.0]], "x double")
    for r in df.select("x", fv.bin_of(F.col("x"), F.lit(0.0), F.lit(0.1)).alias("b")).collect():
        want = next((m for m in range(20) if 0.0 + 0.1 * m <= r.x <= 0.0 + 0.1 * m + 0.1 + (0.1 if m == 19 else 0)), 0)
        assert r.b == want


def test_knn_strategy(nine, spark):
    model = clustering.KnnGraphClustering(k=3, sparsity=0.4, n=9).fit(nine)
    assert grouping(model.predict_all()) == [[0, 2], [1, 3], [4, 5, 6, 7, 8]]
    assert {r.cluster for r in model.predict(nine.limit(1)).collect()} <= {0, 1, 2} and len(model.centers) == 3
    with pytest.raises(ValueError):
        model.predict(points.from_rows(spark, [[0.0] * 6]))
    with pytest.raises(ValueError):
        clustering.KnnGraphClustering(k=3, sparsity=0.4, n=5).fit(nine)
    one = clustering.KnnGraphClustering(k=1, sparsity=0.2).fit(points.from_rows(spark, SINGLE))
    assert grouping(one.predict_all()) == [list(range(9))]


@pytest.mark.parametrize("scaling", ["pos_half", "sym"])
def test_lsh_strategy(nine, scaling):
    s = clustering.LshGraphClustering(k=3, sigma=3.0, share=0.6, power=1, scaling=scaling)
    assert grouping(s.fit(nine).predict_all()) == [[0, 2], [1, 3], [4, 5, 6, 7, 8]]
    e = np.array([r.e for r in s.embed(nine).orderBy("id").collect()])
    block = np.array([0, 1, 0, 1, 2, 2, 2, 2, 2])
    np.testing.assert_allclose(np.abs(e @ e.T), block[:, None] == block[None], atol=1e-6)
    with pytest.raises(ValueError):
        clustering.LshGraphClustering(k=3, share=0.05).fit(nine)


def test_landmark_strategy(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (30, 4)) for c in (0.0, 1.0, 2.0)])
    p = points.from_rows(spark, x.tolist())
    e = np.array([r.e for r in landmarks.landmark_embedding(p, 3, F.col("id") % 4 == 0, 0.5).orderBy("id").collect()])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    same = np.repeat(range(3), 30)[:, None] == np.repeat(range(3), 30)[None]
    gram = np.abs(e @ e.T)
    assert gram[same].min() > 0.95 and gram[~same].max() < 0.1
    model = clustering.LandmarkGraphClustering(k=3, share=0.3, sigma=0.5).fit(p)
    assert grouping(model.predict_all()) == [list(range(a, a + 30)) for a in (0, 30, 60)]
    for share in (0.0, 1.0):
        with pytest.raises(ValueError):
            landmarks.random_split(p, share)
    with pytest.raises(ValueError):
        landmarks.landmark_embedding(p, 3, F.col("id") < 2)


def test_eigen_tiers(spark):
    rng = np.random.default_rng(1)
    m = np.diag(np.arange(40, 0, -1.0)) + 0.1 * rng.normal(size=(40, 40))
    m = (m + m.T) / 2
    edges = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(40) for j in range(40)], "i long, j long, w double")
    _, want = eigen.leading(m, 3)
    for dense in (100, 10):
        e = np.array([r.e for r in eigen.spectral_rows(edges, 3, dense=dense).orderBy("id").collect()])
        np.testing.assert_allclose(e @ e.T, want @ want.T, atol=1e-3)
    low = spark.createDataFrame([(0, 0, 1.0), (1, 1, 0.0)], "i long, j long, w double")
    assert rows_of(eigen.spectral_rows(low, 3), "id", "e")[1] == ([0.0, 0.0, 0.0],)
    assert all(len(r.e) == 3 for r in eigen.spectral_rows(low, 3).collect())


def test_eigen_unconverged(spark):
    edges = spark.createDataFrame([(i, i, 1.0 + i / 100) for i in range(40)], "i long, j long, w double")
    with pytest.raises(RuntimeError, match="still"):
        eigen.distributed_rows(edges, 3, rounds=3)


def test_components(spark):
    from affinigraph.operators.components import components

    rng = np.random.default_rng(4)
    n = 300
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, size=(140, 2))] + [(k, k + 1) for k in range(400, 440)] + [(900, 900), (7, None), (None, None)]
    pairs += [(500, 501 + k) for k in range(60)] + pairs[:5]
    least = {x: x for p in pairs if None not in p for x in p}
    for _ in range(n):
        for a, b in (p for p in pairs if None not in p):
            least[a] = least[b] = min(least[a], least[b])
    got = components(spark.createDataFrame(pairs, "i long, j long"))
    assert {r.id: r.component for r in got.collect()} == least and got.count() == len(least)
    assert components(spark.createDataFrame([], "i long, j long")).count() == 0


def test_lookup_of_small_and_large_tables(spark):
    from affinigraph.operators.lookup import at_both_ends

    edges = spark.createDataFrame([(0, k, 1.0) for k in range(300)] + [(k, 0, 2.0) for k in range(300)], "i long, j long, s double")
    stats = spark.createDataFrame([(k, k / 2) for k in range(300)], "i long, root double")
    small, large = at_both_ends(edges, stats, "root"), at_both_ends(edges, stats, "root", sent=0)
    want = sorted((r.i, r.j, r.s, r.i / 2, r.j / 2) for r in edges.collect())
    for out in (small, large):
        assert sorted(map(tuple, out.select("i", "j", "s", "root_i", "root_j").collect())) == want
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan(small) and "salt_" in plan(large)
    assert at_both_ends(edges.where("s < 0"), stats.where("i < 0"), "root").count() == 0


def test_column_stats_of_wide_vectors(spark):
    x = np.random.default_rng(6).normal(size=(40, 4096))
    x[3, 5] = np.nan
    p = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = {r.pos: (r.low, r.high) for r in buckets.column_stats(p).collect()}
    assert len(got) == 4096 and np.isnan(got[5][1]) and got[5][0] == np.nanmin(x[:, 5])
    assert all(got[c] == (x[:, c].min(), x[:, c].max()) for c in range(4096) if c != 5)
    assert buckets.column_stats(p.where("id < 0"), 4096).count() == 0


def test_eigen_by_component(spark):
    rng = np.random.default_rng(5)
    sizes, at, m = (40, 9, 7, 1, 8), 0, np.zeros((65, 65))
    for n in sizes:
        x = rng.normal(size=(n, n)) + np.diag(np.arange(n, 0, -1.0)) * (20 / n)
        m[at : at + n, at : at + n] = (x + x.T) / 2
        at += n
    i, j = np.nonzero(m)
    edges = spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j, strict=True)], "i long, j long, w double")
    values, want = eigen.leading(m, 6)
    blocks = {int(np.searchsorted(np.cumsum(sizes), np.argmax(np.abs(want[:, c])), "right")) for c in range(6)}
    assert 0 in blocks and len(blocks) > 1  # the large component and small ones both have leading pairs
    for dense in (10, 50):
        rows = eigen.spectral_rows(edges, 6, dense=dense).orderBy("id").collect()
        e = np.array([r.e for r in rows])
        assert [r.id for r in rows] == list(range(65))
        np.testing.assert_allclose(e @ e.T, want @ want.T, atol=1e-3)
        np.testing.assert_allclose(sorted(np.diag(e.T @ m @ e)), sorted(values), rtol=1e-5)


def test_products_of_bucketed_edges(spark):
    """Edges move once, before the rounds; a hub's entries are parted; the tables go when they are forgotten."""
    from affinigraph.sources.store import forget

    rng = np.random.default_rng(7)
    m = np.where(rng.random((60, 60)) < 0.1, rng.normal(size=(60, 60)), 0.0)
    m[:, 9] = rng.normal(size=60)  # a hub
    m[11] = 0  # a row and a column without entries
    m[:, 11] = 0
    edges = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    kept, salts = eigen.by_column(spark.createDataFrame(edges + edges[:5], "i long, j long, w double"), part=100, hub=20)
    for i, j, w in edges[:5]:
        m[i, j] += w  # repeated entries add up
    assert {r.id for r in salts.where("salts > 1").collect()} == {9} and kept.where("j = 9").select("salt").distinct().count() == 3
    x = rng.normal(size=(60, 2))
    vectors = salts.join(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>"), "id").select("id", "salts", "x")
    got = eigen.products(kept, vectors, "x", 2)
    y = np.zeros((60, 2))
    for r in got.collect():
        y[r.id] = r.y
    np.testing.assert_allclose(y, m @ x, atol=1e-12)
    join = got._jdf.queryExecution().executedPlan().toString().split("Join")[1]
    assert "Bucketed: true" in join[: join.index("Exchange")]  # nothing between the kept edges and the join
    assert eigen.products(kept, vectors.where("id < 0"), "x", 2).count() == 0
    tables = len(spark.catalog.listTables())
    forget(kept)
    assert len(spark.catalog.listTables()) == tables - 1


def test_estimators_read_their_input_once(spark):
    """What the checks, the graph and the result need comes from the pass that writes the points."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, (12, 3)) for c in (0.0, 1.0)])
    for s in (clustering.KnnGraphClustering(k=2, sparsity=0.2), clustering.LshGraphClustering(k=2, share=0.2), clustering.LandmarkGraphClustering(k=2, share=0.5)):
        seen = spark.sparkContext.accumulator(0)

        def count(v, seen=seen):
            seen.add(1)
            return v

        p = points.from_rows(spark, x.tolist()).withColumn("v", F.udf(count, "array<double>")("v")).withColumn("extra", F.lit(1))
        assert s.fit(p).predict_all().count() == 24 and seen.value == 24
    p = points.from_rows(spark, x.tolist())
    kept, n = points.checked(p)
    assert (n, points.width_of(kept), points.checked(p, 30)[1], points.checked(p, -1)[1]) == (24, 3, 30, 24)
    assert points.checked(p.withColumn("id", F.lit(None).cast("long")), 3)[0].where("id IS NULL").count() == 24
    with pytest.raises(ValueError, match="id 2[0-3] is not below the given number of points 20"):
        points.checked(p, 20)
    with pytest.raises(ValueError, match="between 1 and 2"):
        points.checked(points.from_rows(spark, [[1.0], [1.0, 2.0]]))
    with pytest.raises(ValueError, match="no points"):
        points.checked(p.where("id < 0"))
    with pytest.raises(ValueError, match="no points"):
        points.checked(points.from_rows(spark, []))
    bad = spark.createDataFrame([("1,x",)], "value string").select(F.lit(0).cast("long").alias("id"), fv.parse_line(F.col("value")).alias("v"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):  # another error stays what it is
        points.checked(bad, 5)


def test_eigen_of_close_values(spark):
    """Values so close that a power iteration would not part them in time, found where the matrix is."""
    edges = spark.createDataFrame([(i, i, 1.0 + i / 40_000) for i in range(400)], "i long, j long, w double")
    e = np.array([r.e for r in eigen.distributed_rows(edges, 3, tolerance=1e-7).orderBy("id").collect()])
    want = np.zeros((400, 3))
    want[[399, 398, 397], [0, 1, 2]] = 1
    assert np.abs(e @ e.T - want @ want.T).max() < 0.05


def test_landmarks_by_products(spark):
    """More landmarks than one place holds: the same span as the dense solution, and orthonormal columns."""
    x = np.random.default_rng(4).normal(size=(150, 16))
    p, marks = points.from_rows(spark, x.tolist()).cache(), F.col("id") % 6 == 0
    one, two = (np.array([r.e for r in landmarks.landmark_embedding(p, 3, marks, 2.0, most=most).orderBy("id").collect()]) for most in (100, 10))
    assert one.shape == two.shape == (150, 3)
    np.testing.assert_allclose(two.T @ two, np.eye(3), atol=1e-9)
    np.testing.assert_allclose(one @ one.T, two @ two.T, atol=1e-4)


def test_kernel_products(spark):
    """Sums of affinities times columns, over several blocks of either side, and the solution of the landmarks' system."""
    rng = np.random.default_rng(6)
    x, y, z = rng.normal(size=(40, 3)), rng.normal(size=(30, 3)), rng.normal(size=(30, 2))
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / 0.5)
    asked = points.from_rows(spark, x.tolist())
    given = spark.createDataFrame([(i, v.tolist(), w.tolist()) for i, (v, w) in enumerate(zip(y, z, strict=True))], "id long, v array<double>, x array<double>")
    got = landmarks.kernel_times(asked, given, 2, 0.5, 1, (3, 2)).orderBy("id").collect()
    np.testing.assert_allclose([r.y for r in got], kernel(x, y) @ z, atol=1e-12)
    b = spark.createDataFrame([(i, float(v)) for i, v in enumerate(z[:, 0])], "id long, b double")
    marks = given.select("id", "v")
    w = landmarks.solve_kernel(marks, b, 0.2, 1, 2).orderBy("id").collect()
    near = np.exp(-((y[:, None] - y[None]) ** 2).sum(2) / 0.08)
    np.testing.assert_allclose([r.w for r in w], np.linalg.solve(near, z[:, 0]), atol=1e-6)
    with pytest.raises(RuntimeError, match="residual"):
        landmarks.solve_kernel(marks, b, 5.0, 1, 2, rounds=2)


def test_bounds_agree_with_blocks(spark):
    """Heaps, equal points, grid points with ties, more neighbours than a ball holds, and few points."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.normal(size=(8, 3)) * 9, 60, 0) + rng.normal(size=(480, 3)) * 0.3, np.ones((60, 3)), rng.integers(0, 3, (60, 3))])
    p = points.from_rows(spark, x.tolist()).cache()
    for t, pivots in ((5, None), (70, 40)):
        found, share = bounds.candidates(p, t, pivots, part=50)
        assert {tuple(r) for r in neighbours.first_per_row(found, t).collect()} == {tuple(r) for r in neighbours.neighbours(p, t).collect()}
        assert share < 0.4
    few = p.where("id < 3")
    assert bounds.neighbours_by_bounds(few, 9).count() == 9
    with pytest.raises(ValueError):
        bounds.neighbours_by_bounds(p, 0)


def sparse_rows(rng, n, width, share):
    return np.where(rng.random((n, width)) < share, rng.normal(size=(n, width)).round(2), 0.0)


def test_sparse_points(spark):
    """Sparse points against the same points filled up: distances, neighbours in one and many blocks, the graph strategy."""
    rng = np.random.default_rng(8)
    x = sparse_rows(rng, 90, 200, 0.03)
    x[:, 7] = rng.normal(size=90)  # a feature that all have
    x[3], x[4], x[5] = 0, x[2], x[2] * (1 + 1e-9)
    full = points.from_rows(spark, x.tolist()).cache()
    thin = full.select("id", sparse.sparse(F.col("v")).alias("v")).cache()
    assert sparse.is_sparse(thin) and not sparse.is_sparse(full)
    assert [r.v for r in thin.select("id", sparse.dense(F.col("v")).alias("v")).orderBy("id").collect()] == x.tolist()
    rows = sparse.Rows.of(thin.orderBy("id").select("v").toArrow().column("v"))
    np.testing.assert_allclose(sparse.squared_distances(rows, rows), ((x[:, None] - x[None]) ** 2).sum(2), rtol=1e-6, atol=1e-15)
    want = {(r.i, r.j, r.rank) for r in neighbours.neighbours(full, 6).collect()}
    for block in (16_384, 128):
        assert {(r.i, r.j, r.rank) for r in neighbours.neighbours(thin, 6, block).collect()} == want
    heaps = np.zeros((30, 50))
    for i in range(30):
        heaps[i, 10 * (i % 3) : 10 * (i % 3) + 5] = 1 + rng.random(5) / 10
    heaps = points.from_rows(spark, heaps.tolist()).select("id", sparse.sparse(F.col("v")).alias("v"))
    model = clustering.KnnGraphClustering(k=3, sparsity=0.2).fit(heaps)
    assert grouping(model.predict_all()) == [list(range(k, 30, 3)) for k in range(3)]
    with pytest.raises(ValueError, match="between"):
        neighbours.neighbours(thin.where("id < 3").unionByName(thin.where("id = 4").select("id", F.struct(F.lit(7).alias("size"), "v.indices", "v.values").cast(sparse.SPARSE).alias("v"))), 2)


def test_sparse_file(spark, tmp_path):
    path = str(tmp_path / "a.txt")
    (tmp_path / "a.txt").write_text("1 1:0.5 3:-2\n0\n\n-1   2:1e3 \n")
    got = {r.label: (r.v.size, r.v.indices, r.v["values"]) for r in sparse.read_sparse(spark, path).collect()}
    assert got == {1.0: (3, [0, 2], [0.5, -2.0]), 0.0: (3, [], []), -1.0: (3, [1], [1000.0])}
    assert sparse.read_sparse(spark, path, 9).first().v.size == 9
    (tmp_path / "a.txt").write_text("1 3:1 2:1\n")
    with pytest.raises(Exception, match="rise"):
        sparse.read_sparse(spark, path).collect()


def test_clean_up_leaves_nothing(spark):
    """Settled tables are deleted too, and a loop keeps those of its last rounds only."""
    t = store.settle(spark.range(5).withColumn("x", F.col("id") * 2))
    path, u = store._path_of[t], store.settle(spark.range(3))
    there = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
    assert there(path) and t.count() == 5
    gone = store._path_of[u]
    store.forget(u)
    assert not there(gone)
    store.clean_up(spark)
    assert not there(path) and store._made[spark.sparkContext.applicationId] == []


def test_published_partitions(spark, nine):
    """The groups that the rows of the fixtures form, by each strategy."""
    assert grouping(clustering.KnnGraphClustering(k=3, sparsity=0.4, n=9).fit(nine).predict_all()) == NINE_GROUPS
    assert grouping(clustering.KnnGraphClustering(k=3, sparsity=0.4, n=9, search="bounds").fit(nine).predict_all()) == NINE_GROUPS
    assert grouping(clustering.LshGraphClustering(k=3, sigma=3.0, share=0.6, power=1).fit(nine).predict_all()) == NINE_GROUPS
    for rows, k, sigma, marks, groups in ((PSEUDO, 2, 0.1, list(range(8)), PSEUDO_GROUPS), (NINE, 3, 3.0, [0, 1, 4, 6, 7], NINE_GROUPS)):

        class Given(clustering.LandmarkGraphClustering):
            def rows(self, p):
                return landmarks.landmark_embedding(p, k, F.col("id").isin(marks), self.sigma, self.power)  # noqa: B023

        assert grouping(Given(k=k, sigma=sigma).fit(points.from_rows(spark, rows)).predict_all()) == sorted(groups)


def test_runs_keep_the_cheapest(spark):
    """Several starts of k-means: no dearer than each of them."""
    p = points.from_rows(spark, np.random.default_rng(9).normal(size=(120, 2)).tolist()).cache()

    def cost(runs, seed):
        model = clustering.PlainKMeans(k=7, runs=runs, seed=seed, max_iter=5, init_mode="random").fit(p)
        return metrics.cost(p, spark.createDataFrame(list(enumerate(model.centers)), "cluster int, c array<double>")).first().cost

    assert cost(3, 1) <= min(cost(1, s) for s in (1, 2, 3)) * (1 + 1e-9)


def test_generated_points(spark, tmp_path):
    """Slices, points within the scatter above their centres, and the command-line pipelines on a file of three heaps."""
    got = [tuple(r) for r in datagen.slices(spark, 1003, 8).orderBy("part").collect()]
    assert got == [(i, i * 126 if i < 3 else i * 125 + 3, (i + 1) * 126 if i < 3 else (i + 1) * 125 + 3) for i in range(8)]
    g = datagen.clustered_points(spark, 2000, 8, 5, 0.02).join(datagen.centres(spark, 5, 8).withColumnRenamed("v", "c"), "cluster").collect()
    v, c = np.array([r.v for r in g]), np.array([r.c for r in g])
    assert v.shape == (2000, 8) and (v >= 0).all() and (v <= 1).all() and (((v - c >= 0) & (v - c < 0.02)) | (v == 1) | (v == 0)).all()
    heaps = [[float(i % 3 == c) + i * c / 1e5 for c in range(4)] for i in range(240)]
    path = str(tmp_path / "heaps")
    points.write_csv_vectors(points.from_rows(spark, heaps), path)
    for r in (
        pipelines.run_kmeans(spark, path, 2, 3), pipelines.run_knn_graph(spark, path, 2, 0.2, 3), pipelines.run_lsh(spark, path, 2, 1.0, 3, 0.2),
        pipelines.run_landmark(spark, path, 2, 0.3, 0.2, 3),
    ):
        assert sorted(r["sizes"].values()) == [80, 80, 80] and r["wssse"] < 0.1


def test_distances_keep_their_digits():
    from affinigraph.functions.blocks import nearest, squared_distances

    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 6)) + 1e6
    x[1] = x[0] + 1e-4
    want = ((x[:, None] - x[None]) ** 2).sum(2)
    np.testing.assert_allclose(squared_distances(x, x), want, rtol=1e-9, atol=1e-12)
    y = np.concatenate([x, x[:5]])  # ties go to smaller ids
    row, at, d = nearest(x, y, np.arange(len(y))[::-1], 2)
    assert (np.bincount(row) == 2).all() and at[row == 0].tolist() == [50, 0] and d[0] == 0


def test_buckets_in_rounds(spark):
    rng = np.random.default_rng(6)
    for _ in range(3):
        sigs = [(int(s), i) for i, s in enumerate(rng.permutation(64)[:40])]
        df = spark.createDataFrame([(s, i, 1) for s, i in sigs], "sig long, first_id long, n long")
        assert {r.sig: r.bucket for r in buckets.lead_in_rounds(df).collect()} == dict(buckets.lead_signatures(sigs))


def test_dense_index_of_many_rows(spark):
    """More rows than the range sampler reads, so that a second run would cut other ranges."""
    p = spark.range(2_000_000).select(F.xxhash64("id").alias("id"))
    got = points.dense_index(p)
    r = got.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("a"), F.max("idx").alias("b")).first()
    assert tuple(r) == (2_000_000, 2_000_000, 0, 1_999_999)
    order = got.select("id", "idx").where("idx < 1000 OR idx > 1990000").orderBy("id").select("idx").collect()
    assert [r.idx for r in order] == sorted(r.idx for r in order)


def test_plain_kmeans_embeds_nothing(nine):
    assert {tuple(r.v) == tuple(r.e) for r in clustering.PlainKMeans(k=2).embed(nine).collect()} == {True}


def test_edge_cases(spark):
    same = points.from_rows(spark, [[1.0, 2.0]] * 6)
    near = neighbours.neighbours(same, 2)
    assert {r.s for r in graph.self_tuned_affinity(near).collect()} == {1.0}
    assert buckets.buckets(buckets.signatures(same, buckets.fit_hash(same))).select("bucket").distinct().count() == 1
    assert points.distinct_vectors(same).collect()[0].id == 0
    with pytest.raises(ValueError):
        neighbours.neighbours(same, 0)
    assert rows_of(same.select("id", fv.unit_row(F.array(F.lit(0.0), F.lit(0.0)), 2).alias("e")), "id", "e")[0] == ([1.0, 1.0],)
    one = same.withColumn("cluster", F.lit(0))
    assert metrics.dbi(one).first()[0] == 0 and metrics.wssse(one).first()[0] == 0
    with pytest.raises(ValueError):
        points.width_of(points.from_rows(spark, [[1.0], [1.0, 2.0]]))


def test_metrics(spark):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(60, 3)), rng.integers(0, 4, 60)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c, strict=True))], "id long, v array<double>, cluster int")
    mean = np.array([x[c == k].mean(0) for k in range(4)])
    d = ((x - mean[c]) ** 2).sum(1)
    total, avg = np.bincount(c, d), np.bincount(c, d) / np.bincount(c)
    apart = ((mean[:, None] - mean[None]) ** 2).sum(2)
    worst = [max((avg[i] + avg[j]) / apart[i, j] for j in range(4) if j != i) for i in range(4)]
    assert math.isclose(metrics.wssse(df).first()[0], total.sum()) and math.isclose(metrics.ase(df).first()[0], (total**2).sum() / 60) and math.isclose(metrics.dbi(df).first()[0], np.mean(worst))


def test_sources(spark, tmp_path):
    p = points.from_rows(spark, NINE)
    points.write_csv_vectors(p, f"{tmp_path}/v")
    points.write_csv_vectors(p, f"{tmp_path}/v")
    assert sorted(r.v for r in points.read_csv_vectors(spark, f"{tmp_path}/v").collect()) == sorted(NINE)
    (tmp_path / "bad").write_text("1,2\n1,x\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        points.read_csv_vectors(spark, f"{tmp_path}/bad").collect()
    (tmp_path / "trail").write_text("1,2,,\n")
    assert points.read_csv_vectors(spark, f"{tmp_path}/trail").first().v == [1.0, 2.0]
    (tmp_path / "svm").write_text("1 1:0.5 3:2.0\n0 2:1.0\n")
    assert points.read_labelled_sparse(spark, f"{tmp_path}/svm", 3).count() == 2
    assert sorted(r.idx for r in points.dense_index(p.where("id <> 3")).collect()) == list(range(8))
    g = datagen.clustered_points(spark, 500, 4, 3, 0.02).cache()
    assert g.count() == 500 and g.select(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()[0] >= 0
    assert [(r.start, r.end) for r in datagen.slices(spark, 10, 4).orderBy("part").collect()] == [(0, 3), (3, 6), (6, 8), (8, 10)]


def test_pipelines(spark, tmp_path, capsys):
    path = pipelines.generate(spark, str(tmp_path), 2, 120, 4, "t", 3, 0.01)
    for out in (pipelines.run_kmeans(spark, path, 2, 3), pipelines.run_knn_graph(spark, path, 2, 0.2, 3), pipelines.run_lsh(spark, path, 2, 1.0, 3, 0.2), pipelines.run_landmark(spark, path, 2, 0.3, 0.2, 3)):
        assert sum(out["sizes"].values()) == 120 and out["wssse"] >= 0 and out["seconds"] > 0
    assert pipelines.main(["lsh", "too", "few"]) == 2


def test_neighbours_cross_signatures(spark):
    d = "/root/testdata/sf0.1"
    sig = {r.id: r.sig for r in catalogue.queries()["lsh_signatures"](spark, d).collect()}
    bucket = {r.id: r.bucket for r in catalogue.queries()["lsh_buckets"](spark, d).collect()}
    near = catalogue.queries()["lsh_bucket_knn"](spark, d).collect()
    assert all(bucket[r.i] == bucket[r.j] for r in near) and any(sig[r.i] != sig[r.j] for r in near)


ORACLES = sorted(catalogue.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, duck, name):
    a = catalogue.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    b = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    for c in cols:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), atol=2e-6)
        else:
            assert a[c].tolist() == b[c].tolist()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_edges_become_stars(spark):
    """Of many edges between the same vertices a row for each vertex is left, and it leads to the least one."""
    from affinigraph.operators.components import least_of, stars

    edges = spark.range(20_000).select((F.col("id") % 100).alias("i"), (F.col("id") * 7 % 100).alias("j")).repartition(2)
    rows = stars(edges).collect()
    assert len(rows) <= 200 and {r.i for r in rows} == set(range(100)) and all(r.j <= r.i for r in rows)
    ids, least = least_of(np.arange(1, 5000), np.arange(4999))  # a path
    assert (ids == np.arange(5000)).all() and not least.any()


def test_products_stay_in_the_engine(spark):
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(5) for j in range(5)], "i long, j long, w double")
    kept, salts = eigen.by_column(edges)
    got = eigen.products(kept, salts.withColumn("x", F.array(F.lit(1.0), F.lit(2.0))), "x", 2)
    assert {tuple(r.y) for r in got.collect()} == {(5.0, 10.0)} and "InArrow" not in got._jdf.queryExecution().toString()


def test_points_move_in_few_blocks(spark):
    """Small blocks are dealt together, so that moving all points to every block stays in proportion to the points."""
    assert [neighbours.dealt(n, 100) for n in (90, 500, 10_000, 100_000, 600_000)] == [1, 5, 24, 24, 24]
    sizes = spark.createDataFrame([(n,) for n in (90, 500, 10_000, 100_000, 600_000)], "n long")
    assert [r.parts for r in sizes.select(neighbours.dealt_of(F.col("n"), 100).alias("parts")).collect()] == [1, 5, 24, 24, 24]
    x = np.random.default_rng(8).normal(size=(700, 3))
    p = points.from_rows(spark, x.tolist())
    near = neighbours.neighbours(p, 3, block=5)
    want = {(r.i, r.j, r.rank) for r in neighbours.neighbours(p, 3).collect()}
    assert {(r.i, r.j, r.rank) for r in near.collect()} == want
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for block in (4, 100, 1000):
        rows = neighbours.pair_summary(p, block).orderBy("i").collect()
        assert [r.n for r in rows] == [700] * 700
        np.testing.assert_allclose([(r.total, r.low, r.high) for r in rows], np.stack([d.sum(1), d.min(1), d.max(1)], 1), rtol=1e-9, atol=1e-12)


def test_a_bucket_of_most_points_is_not_one_task(spark):
    """Bucket sizes are looked up where the points are, and a salted join takes over when there are many buckets."""
    own = spark.range(4000).select("id", F.array((F.col("id") % 97).cast("double")).alias("v"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("bucket"))
    near = neighbours.bucket_neighbours(own, 2)
    assert near.count() == 2000 * 2 + 2000
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_graph_steps_read_their_rows_once(spark):
    from affinigraph.operators import components

    seen = spark.sparkContext.accumulator(0)

    def count(d):
        seen.add(1)
        return d

    near = points.from_rows(spark, [[0.0], [1.0], [3.0], [4.0]]).select(F.col("id").alias("i"), (3 - F.col("id")).alias("j"), F.udf(count, "double")(F.col("v")[0]).alias("d"))
    for step in (graph.symmetric_edges, graph.mean_distances, graph.self_tuned_affinity, lambda n: graph.graph_matrix(graph.width_affinity(n, 1.0)), components.components):
        seen.value = 0
        step(near).collect()
        assert seen.value <= 4


def test_bounds_give_way_to_blocks(spark, monkeypatch):
    """Points whose balls rule out nothing are compared in blocks, with the same result."""
    x = np.random.default_rng(9).normal(size=(400, 24))
    p = points.from_rows(spark, x.tolist())
    want = {(r.i, r.j, r.rank) for r in neighbours.neighbours(p, 4).collect()}
    found, share = bounds.candidates(p, 4, 40)
    assert share == 1.0 and {(r.i, r.j, r.rank) for r in neighbours.first_per_row(found, 4).collect()} == want
    monkeypatch.setattr(bounds, "FEW", 1000)
    found, share = bounds.candidates(p, 4, 40)
    assert share > 0.5 and {(r.i, r.j, r.rank) for r in neighbours.first_per_row(found, 4).collect()} == want


def test_neighbours_are_swept(spark):
    """A block passes all points some at a time and keeps t of each: no candidates move, and single precision decides nothing."""
    from affinigraph.functions.blocks import Nearest, nearest

    rng = np.random.default_rng(11)
    few = rng.integers(0, 3, size=(90, 3)).astype(float)  # copies and ties
    for x in (rng.normal(size=(90, 8)), few, rng.normal(size=(90, 4)) + 1e6, rng.normal(size=(90, 4)) * 1e20, rng.normal(size=(90, 4)) * 1e-25, np.concatenate([few, [[1e9] * 3]])):
        ids = rng.permutation(len(x))
        held = Nearest(x, 7)
        for a in range(0, len(x), 13):
            held.add(x[a : a + 13], ids[a : a + 13])
        row, at, d = nearest(x, x, ids, 7)
        got = [np.concatenate(c) for c in zip(*held.found(), strict=True)]
        assert (got[0] == row).all() and (got[1] == ids[at]).all() and (got[2] == d).all()
    p = points.from_rows(spark, rng.normal(size=(300, 3)).tolist())
    for near in (neighbours.neighbours(p, 3, block=20), neighbours.bucket_neighbours(p.withColumn("bucket", F.col("id") % 2), 3, small=0, block=20)):
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        assert near.count() == 900 and "Window" not in plan and "FlatMapGroups" not in plan
    parts = [neighbours.swept_blocks(n, neighbours.BLOCK, 10) for n in (90, 10_256, 102_560, 615_360, 6_153_600)]
    assert parts == [1, 24, 24, 24, 188] and neighbours.swept_blocks(10_256, neighbours.BLOCK, 1000) == 24


def test_hash_bits_read_written_points(spark, monkeypatch):
    """The points of the hash queries are evaluated once, not for each bit."""
    made = []
    monkeypatch.setattr(catalogue, "settle", lambda df: made.append(store.settle(df)) or made[-1])
    signed = catalogue.signed(spark, "/root/testdata/sf0.001")
    assert len(made) == 2 and signed.count() == 500


def test_landmark_products_share_affinities(spark, monkeypatch):
    """Landmarks that a task can hold are met by each block of points once a round, for both products; the result is that of blocks
    of landmarks."""
    x = np.random.default_rng(4).normal(size=(60, 16))
    p, marks = points.from_rows(spark, x.tolist()).cache(), F.col("id") % 4 == 0
    made = []
    once = landmarks.kernel_both_ways
    monkeypatch.setattr(landmarks, "kernel_both_ways", lambda *a: made.append(a) or once(*a))
    e = np.array([r.e for r in landmarks.embedding_by_products(p, 3, marks, 2.0).orderBy("id").collect()])
    assert made
    dense = np.array([r.e for r in landmarks.landmark_embedding(p, 3, marks, 2.0).orderBy("id").collect()])
    np.testing.assert_allclose(e @ e.T, dense @ dense.T, atol=1e-4)
    for sigma, power in ((2.0, 1), (2.0, 2), (0.0, 1), (1e-9, 1)):
        own = landmarks.Landmarks(np.arange(60), x, sigma, power)
        np.testing.assert_allclose(np.concatenate([s for _, _, s in own.slices(x)]), own.affinity(x), rtol=1e-9, atol=1e-300)
    first = eigen._gram(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:, :3])], "id long, s array<double>"))
    np.testing.assert_allclose(first, x[:, :3].T @ x[:, :3])


def test_ties_that_lose_are_not_sorted(monkeypatch):
    from affinigraph.functions import blocks

    x, ids = np.ones((64, 5)), np.arange(5000)
    held, sorted_in = blocks.Nearest(x, 7), []
    lexsort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_in.append(len(keys[0])) or lexsort(keys))
    held.add(np.ones((4096, 5)), ids[:4096])
    first = len(sorted_in)
    held.add(np.ones((904, 5)), ids[4096:])  # as near, of larger ids
    assert all(n <= 7 * 64 for n in sorted_in[first:])
    held.add(np.ones((1, 5)), np.array([-1]))
    assert {(int(i), int(j)) for i, to, _, _ in held.found() for i, j in zip(i, to, strict=True)} == {(i, j) for i in range(64) for j in range(-1, 6)}


def test_places():
    from affinigraph.functions.blocks import places

    for shape in ((3, 16), (5, 7), (1, 8), (0, 4), (4096, 1)):
        for share in (0, 0.01, 0.5, 1):
            flags = np.random.default_rng(5).random(shape) < share
            assert places(flags).tolist() == np.flatnonzero(flags).tolist()


def test_a_block_holds_no_more_when_more_points_pass():
    import tracemalloc

    from affinigraph.functions.blocks import Nearest

    rng, most = np.random.default_rng(3), []
    for parts in (6, 30):
        tracemalloc.start()
        held = Nearest(rng.normal(size=(1000, 16)), 10)
        for k in range(parts):
            held.add(rng.normal(size=(2000, 16)), np.arange(2000) + 2000 * k)
        assert sum(len(i) for i, *_ in held.found()) == 10_000
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most[1] < 1.1 * most[0]


def test_packed_graph(spark):
    """A graph whose vertices are held: its entries, products and leading pairs are those of the rows, whatever the ids are."""
    from affinigraph.operators import packed

    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    x[100:120] = x[100]  # equal points: means and distances of zero
    p = points.from_rows(spark, x.tolist()).select((F.col("id") * 1_000_003 - 7).alias("id"), "v")
    near = store.settle(neighbours.neighbours(p, 8))
    ids = packed.ids_of(p.select("id"))
    for sigma, affinity in ((None, graph.self_tuned_affinity(near)), (1.5, graph.width_affinity(near, 1.5)), (0.0, graph.width_affinity(near, 0.0))):
        for scaling in ("pos_half", "sym"):
            rows = graph.graph_matrix(affinity, scaling).toPandas()
            want = np.zeros((300, 300))
            want[np.searchsorted(ids, rows.i), np.searchsorted(ids, rows.j)] = rows.w
            m = packed.graph_of_neighbours(near, ids, 2400, scaling, sigma)
            got, again = np.zeros((300, 300)), m.rows().toPandas()
            got[np.searchsorted(ids, again.i), np.searchsorted(ids, again.j)] = again.w
            assert len(again) == len(rows)
            np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-300)
            y = rng.normal(size=(300, 5))
            np.testing.assert_allclose(m.times(y), want @ y, atol=1e-9)
    m = packed.graph_of_neighbours(near, ids, 2400, "pos_half")
    dense = m.rows().toPandas()
    a = np.zeros((300, 300))
    a[np.searchsorted(ids, dense.i), np.searchsorted(ids, dense.j)] = dense.w
    values, want = eigen.leading(a, 4)
    for e in (packed.pairs_of(m, 4)[0], eigen.packed_rows(m, 4, rounds=1)):  # the second: not settled in time, so by components
        e = np.array([r.e for r in e.orderBy("id").collect()])
        np.testing.assert_allclose(np.diag(e.T @ a @ e) if np.ptp(values) else values, values, rtol=1e-5)
        np.testing.assert_allclose(a @ e, e * values[None], atol=1e-4 * abs(values).max())
    with pytest.raises(RuntimeError, match="still"):
        packed.pairs_of(m, 4, rounds=1)


def test_held_pairs():
    """Close and repeated values, of both signs, with a basis that is cut on the way; products that stay in the basis."""
    from affinigraph.operators import packed

    good = lambda r, _, largest: (r <= 1e-7 * largest).all()
    d = np.concatenate([1 + np.arange(400) / 400, [-2.5, -2.5]])
    values, v = packed.held_pairs(lambda x: d[:, None] * x, 402, 3, settled=good)
    np.testing.assert_allclose(values, [-2.5, -2.5, 1 + 399 / 400], rtol=1e-9)
    np.testing.assert_allclose(v.T @ v, np.eye(3), atol=1e-9)
    values, _ = packed.held_pairs(lambda x: np.zeros_like(x), 5, 3, settled=lambda *_: False)
    assert (values == 0).all()


def test_large_graph_strategies_are_packed(spark, monkeypatch):
    """Strategies over more points than are solved densely keep the graph packed: no row is made for an entry after the neighbours."""
    x = np.concatenate([np.random.default_rng(c).normal(size=(40, 4)) + 8 * c for c in range(3)])
    p = points.from_rows(spark, x.tolist())
    want = [clustering.KnnGraphClustering(k=3, sparsity=0.1), clustering.LshGraphClustering(k=3, sigma=3.0, share=0.1)]
    want = [np.array([r.e for r in s.embed(p).orderBy("id").collect()]) for s in want]
    monkeypatch.setattr(eigen, "DENSE", 20)
    monkeypatch.setattr(graph, "graph_matrix", None)
    for s, e in zip((clustering.KnnGraphClustering(k=3, sparsity=0.1), clustering.LshGraphClustering(k=3, sigma=3.0, share=0.1)), want, strict=True):
        got = np.array([r.e for r in s.embed(p).orderBy("id").collect()])
        np.testing.assert_allclose(got @ got.T, e @ e.T, atol=1e-3)


def test_two_sided_graph(spark, monkeypatch):
    """Entries between few vertices and many: leading pairs of both signs without vectors of the many between rounds."""
    from affinigraph.operators import packed

    rng = np.random.default_rng(4)
    m = np.zeros((330, 330))
    m[:30, 30:] = rng.uniform(1, 2, size=(30, 300)) * (rng.uniform(size=(30, 300)) < 0.3)
    m[0, 30:] += 3
    m = m + m.T
    i, j = np.nonzero(m)
    ids = rng.permutation(330) * 1_000_001 - 5
    rows = [(int(ids[a]), int(ids[b]), float(m[a, b])) for a, b in zip(i, j, strict=True)]
    edges = store.settle(spark.createDataFrame(rows, "i long, j long, w double"))
    loop = spark.createDataFrame([*rows[1:], (int(ids[0]), int(ids[1]), 1.0)], "i long, j long, w double")
    assert packed.two_sided(store.settle(loop)) is None and packed.two_sided(edges, most=29) is None
    assert list(packed.two_sided(edges).ids) == sorted(ids[:30])
    monkeypatch.setattr(eigen, "by_column", None)  # the entries are not dealt by columns for rounds
    monkeypatch.setattr(packed, "SLICE", 7)
    for k in (2, 3):
        e, values = eigen.distributed_pairs(edges, k)
        e = {r.id: r.e for r in e.collect()}
        e = np.array([e[int(x)] for x in ids])
        np.testing.assert_allclose(np.abs(values), np.sort(np.abs(np.linalg.eigvalsh(m)))[::-1][:k], rtol=1e-9)
        np.testing.assert_allclose(m @ e, e * values[None], atol=1e-4 * values[0])
        np.testing.assert_allclose(e.T @ e, np.eye(k), atol=1e-6)


def test_sparse_points_are_made_once(spark):
    """Neighbours of sparse points evaluate their input once: width, number and blocks read what was written."""
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    p = spark.createDataFrame([(i, [float(i % 7), 0.0, float(i)]) for i in range(50)], "id long, v array<double>").mapInArrow(seen, "id long, v array<double>")
    near = neighbours.neighbours(p.select("id", sparse.sparse(F.col("v")).alias("v")), 3)
    assert near.count() == 150 and made.value == 50
