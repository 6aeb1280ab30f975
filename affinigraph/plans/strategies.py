"""Queries of the estimators and pipelines. Labels, signs and rotations are free, so what SQL can check is what holds for any:
residuals, lengths, products, partitions of fixtures and agreement with the model's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import buckets, clustering, eigen, graph, landmarks, metrics
from ..sources import points
from ..sources.store import new_path, settle
from . import pipelines
from .catalogue import DIGEST, EMBED_K, LEAD, LEVELS, LM_SIGMA, SIGMA, SIGS, P, bucket_near, digest, embeddings, near, query, r6, signed

@query()
def landmark_embed(spark, d):
    return landmarks.landmark_embedding(embeddings(spark, d), EMBED_K, F.col("id") % 50 == 0, LM_SIGMA)


@query()
def knn_embed(spark, d):
    return clustering.KnnGraphClustering(k=EMBED_K, sparsity=0.02).embed(embeddings(spark, d)).select("id", "e")


@query()
def lsh_embed(spark, d):
    return clustering.LshGraphClustering(k=EMBED_K, sigma=SIGMA, share=0.02).embed(embeddings(spark, d)).select("id", "e")


@query()
def knn_cluster(spark, d):
    return clustering.KnnGraphClustering(k=EMBED_K, sparsity=0.02).fit(embeddings(spark, d)).predict_all().select("id", "cluster")


@query()
def knn_cluster_sizes(spark, d):
    """Flagship: distinct points to cluster sizes, through the nearest-neighbour graph."""
    p = points.distinct_vectors(embeddings(spark, d))
    return metrics.cluster_sizes(clustering.KnnGraphClustering(k=EMBED_K, sparsity=0.02).fit(p).predict_all())


@query()
def lsh_cluster(spark, d):
    return clustering.LshGraphClustering(k=EMBED_K, sigma=SIGMA, share=0.02).fit(embeddings(spark, d)).predict_all().select("id", "cluster")


@query()
def landmark_cluster(spark, d):
    return clustering.LandmarkGraphClustering(k=EMBED_K, share=0.2, sigma=LM_SIGMA).fit(embeddings(spark, d)).predict_all().select("id", "cluster")


@query()
def kmeans_cluster(spark, d):
    return clustering.PlainKMeans(k=10).fit(embeddings(spark, d)).predict_all().select("id", "cluster")


# What SQL can check

SETTLED = f"SELECT CAST(i AS INTEGER) AS nth, 1.0 AS length, true AS settled FROM range({EMBED_K}) t(i)"


def residuals(matrix: DataFrame, e: DataFrame) -> DataFrame:
    """(nth, length, settled): of each eigenvector v its length, and whether A v is v times its Rayleigh quotient."""
    v = settle(e.select(F.col("id").alias("i"), F.posexplode("e").alias("nth", "x")))
    av = matrix.join(v.select(F.col("i").alias("j"), "nth", "x"), "j").groupBy("i", "nth").agg(F.sum(F.col("w") * F.col("x")).alias("y"))
    both = settle(v.join(av, ["i", "nth"]))
    value = both.groupBy("nth").agg(F.sum(F.col("x") * F.col("y")).alias("value"), r6(F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("length"))
    gap = both.join(value, "nth").groupBy("nth", "length", "value").agg(F.sqrt(F.sum((F.col("y") - F.col("value") * F.col("x")) ** 2)).alias("r"))
    return gap.select("nth", "length", (F.col("r") <= 1e-5 * F.abs("value")).alias("settled"))


@query(SETTLED)
def knn_spectrum(spark, d):
    w = settle(graph.graph_matrix(graph.self_tuned_affinity(near(spark, d))))
    return residuals(w, eigen.spectral_rows(w, EMBED_K))


@query(SETTLED)
def lsh_spectrum(spark, d):
    own = settle(buckets.buckets(signed(spark, d)).select(F.col("id").alias("i"), "bucket"))
    w = settle(graph.graph_matrix(graph.width_affinity(bucket_near(spark, d), SIGMA)).join(own, "i"))
    return residuals(w, eigen.spectral_rows(w, EMBED_K, block="bucket"))


#: Quantities by order and supplier, and the largest eigenvalue of the suppliers' products by 24 rounds of powers, whose share of
#: other vectors falls by some 2.3 ** 2 a round. The matrix of orders and suppliers has its roots, of both signs.
POWERS = 24
HUBS = f"""WITH q AS MATERIALIZED (SELECT l_orderkey AS o, l_suppkey AS s, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
m AS MATERIALIZED (SELECT a.s AS s, b.s AS t, sum(a.w * b.w) AS w FROM q a JOIN q b USING (o) GROUP BY ALL),
x0 AS MATERIALIZED (SELECT DISTINCT s, 1e0 AS x FROM m),
{" ".join(f"x{n + 1} AS MATERIALIZED (SELECT m.s, sum(m.w * x.x) / (SELECT sum(w) FROM m) AS x FROM m JOIN x{n} x ON x.s = m.t GROUP BY m.s)," for n in range(POWERS))}
r AS (SELECT sum(a.x * m.w * b.x) / (SELECT sum(x * x) FROM x{POWERS}) AS value FROM x{POWERS} a JOIN m ON m.s = a.s JOIN x{POWERS} b ON b.s = m.t)
SELECT CAST(i AS INTEGER) AS nth, round(sqrt(value), 4) AS size, true AS settled FROM r, range(2) t(i)"""


@query(HUBS)
def order_supplier_spectrum(spark, d):
    """The leading pairs of the matrix of orders and suppliers, which is too large for one place and whose suppliers are hubs."""
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    q = t.groupBy((2 * F.col("l_orderkey")).alias("o"), (2 * F.col("l_suppkey") + 1).alias("s")).agg(F.sum("l_quantity").alias("w"))
    w = settle(q.select(F.col("o").alias("i"), F.col("s").alias("j"), "w").union(q.select("s", "o", "w")))
    rows, values = eigen.distributed_pairs(w, 2)
    sizes = spark.createDataFrame([(n, round(abs(float(v)), 4)) for n, v in enumerate(values)], "nth int, size double")
    return sizes.join(residuals(w, rows).select("nth", "settled"), "nth")


@query(f"SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS g FROM range({EMBED_K}) x(a), range({EMBED_K}) y(b)")
def landmark_products(spark, d):
    """Columns of the landmark embedding are orthonormal over all points."""
    e = settle(landmarks.landmark_embedding(embeddings(spark, d), EMBED_K, F.col("id") % 50 == 0, LM_SIGMA).select("id", F.posexplode("e").alias("a", "x")))
    other = e.select("id", F.col("a").alias("b"), F.col("x").alias("y"))
    g = e.join(other, "id").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g"))
    return g.select("a", "b", (F.round("g", 6) + F.lit(0.0)).alias("g"))


@query(f"SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS g FROM range({EMBED_K}) x(a), range({EMBED_K}) y(b)")
def landmark_by_products(spark, d):
    """The embedding of landmarks that stay rows of a table spans what the dense solution spans: of the products of the columns
    of both, the products with each other are those of a rotation."""
    p, marks = settle(embeddings(spark, d)), F.col("id") % 20 == 0
    one = landmarks.landmark_embedding(p, EMBED_K, marks, LM_SIGMA)
    two = landmarks.landmark_embedding(p, EMBED_K, marks, LM_SIGMA, most=p.where(marks).count() // 2)
    one, two = (settle(e.select("id", F.posexplode("e").alias(c, x))) for e, c, x in ((one, "c", "x"), (two, "a", "y")))
    across = settle(one.join(two, "id").groupBy("c", "a").agg(F.sum(F.col("x") * F.col("y")).alias("g")))
    other = across.select("c", F.col("a").alias("b"), F.col("g").alias("h"))
    g = across.join(other, "c").groupBy("a", "b").agg(F.sum(F.col("g") * F.col("h")).alias("g"))
    return g.select("a", "b", (F.round("g", 4) + F.lit(0.0)).alias("g"))


@query(f"{P} SELECT id, 1.0 AS knn, 1.0 AS lsh, 1.0 AS landmark FROM p")
def embedded_lengths(spark, d):
    """Every point has a row of length 1 in each strategy's embedding (or ones, where its row is zero)."""
    p = embeddings(spark, d)
    out = p.select("id")
    for name, s in (
        ("knn", clustering.KnnGraphClustering(k=EMBED_K, sparsity=0.02)), ("lsh", clustering.LshGraphClustering(k=EMBED_K, sigma=SIGMA, share=0.02)),
        ("landmark", clustering.LandmarkGraphClustering(k=EMBED_K, share=0.2, sigma=LM_SIGMA)),
    ):
        n = F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)
        ones = F.forall("e", lambda x: x == 1)
        out = out.join(s.embed(p).select("id", F.when(ones, 1.0).otherwise(r6(F.sqrt(n))).alias(name)), "id")
    return out


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS wrong FROM embeddings")
def kmeans_nearest(spark, d):
    """Points that plain k-means does not assign to the nearest of its centres."""
    model = clustering.PlainKMeans(k=10).fit(embeddings(spark, d))
    centres = spark.createDataFrame(list(enumerate(model.centers)), "cluster int, c array<double>")
    best = metrics.nearest_centre(embeddings(spark, d), centres).select("id", F.col("cluster").alias("best"))
    both = model.predict_all().join(best, "id")
    return both.agg(F.count("*").alias("n"), F.sum((F.col("cluster") != F.col("best")).cast("long")).alias("wrong"))


@query(f"{P} SELECT id, true AS same, {EMBED_K} AS width FROM p")
def predict_agrees(spark, d):
    """A fitted model's lookup by vectors and its embedding rows, against its table of all assignments."""
    p = embeddings(spark, d)
    model = clustering.LandmarkGraphClustering(k=EMBED_K, share=0.2, sigma=LM_SIGMA).fit(p)
    found = p.join(model.predict(p).withColumnRenamed("cluster", "own"), "v").join(model.project(p), "v").join(model.predict_all().select("id", "cluster"), "id")
    return found.select("id", (F.col("own") == F.col("cluster")).alias("same"), F.size("e").alias("width"))


@query(f"{P} SELECT count(*) AS n, count(DISTINCT v) AS points, 10 AS clusters, true AS agrees FROM p")
def pipeline_report(spark, d):
    """The k-means command over a file of all vectors: the cost of its centres is that of its clusters, or a little more."""
    path = new_path(spark, "csv")
    p = embeddings(spark, d)
    points.write_csv_vectors(p, path)
    r = pipelines.run_kmeans(spark, path, 8, 10)
    centres = spark.createDataFrame(list(enumerate(r["centers"])), "cluster int, c array<double>")
    cost = metrics.cost(points.distinct_vectors(p), centres)
    agrees = F.lit(r["wssse"]) <= F.col("cost") * (1 + 1e-9)
    report = cost.select(F.lit(sum(r["sizes"].values())).cast("long").alias("points"), F.lit(len(r["sizes"])).alias("clusters"), (agrees & (F.col("cost") < 1.1 * r["wssse"])).alias("agrees"))
    return p.agg(F.count("*").alias("n")).crossJoin(report)  # one row each


@query(f"{P} SELECT {DIGEST.format(v='v')} AS digest, CAST(len(v) AS INTEGER) AS width FROM p")
def csv_file(spark, d):
    """Vectors written as lines of a file, over what is there, and read again."""
    path = new_path(spark, "csv")
    p = embeddings(spark, d)
    for _ in range(2):
        points.write_csv_vectors(p, path)
    return points.read_csv_vectors(spark, path).select(digest(F.col("v")).alias("digest"), F.size("v").alias("width"))


@query("SELECT count(*) AS n, true AS close FROM lineitem")
def random_split(spark, d):
    """A fifth of all line items, give or take what chance does."""
    p = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    share = F.avg(F.col("landmark").cast("double"))
    return landmarks.random_split(p, 0.2).agg(F.count("*").alias("n"), (F.abs(share - 0.2) < 5 * F.sqrt(F.lit(0.16) / F.count("*"))).alias("close"))


@query(f"{LEAD} SELECT id, sig, bucket FROM bk")
def lsh_buckets_in_rounds(spark, d):
    """The form for more signatures than the driver groups."""
    return buckets.buckets(signed(spark, d), most=0).select("id", "sig", "bucket")


PLANES = f"{P}, th(bit, pos, threshold) AS (VALUES (0, 3, 0.5), (1, 0, 0.0), (2, 3, -0.5), (3, 9, 0.0))"


@query(f"{PLANES}{SIGS.removeprefix(LEVELS)}{LEAD.removeprefix(SIGS)} SELECT id, sig, bucket FROM bk")
def lsh_given_planes(spark, d):
    return buckets.lsh_buckets(embeddings(spark, d), [3, 0, 3, 9], [0.5, 0.0, -0.5, 0.0]).select("id", "sig", "bucket")
