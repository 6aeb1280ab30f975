"""Named queries of the library over the test tables, and the same results in SQL.

Outputs are scalars rounded to six decimals, so that engines which add in another order agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as fv
from ..operators import bounds, buckets, clustering, components, graph, landmarks, metrics, neighbours, sparse
from ..sources import points
from ..sources.store import settle

WIDTH = 64
T = 10
#: Affinities of the hash and landmark queries have this width; distances in the table are near 120.
SIGMA = 120.0
EMBED_K = 4

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return points.points_of(table(spark, d, "embeddings"), "vec_id", "embedding")


def orders4(spark: SparkSession, d: str) -> DataFrame:
    """Four numbers of each line item as a point; the return flag stands for a cluster."""
    t = table(spark, d, "lineitem")
    return t.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))).alias("v"), F.col("l_returnflag").alias("cluster"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings")
    return t.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("cluster"))


def near(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbours(embeddings(spark, d), T)


def r6(c):
    return F.round(c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


#: A digest of all values of a vector: each weighted by its place.
DIGEST = "round(list_sum(list_transform({v}, lambda x, i: x * i)), 4)"


def digest(v):
    return F.round(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4)


P = "WITH RECURSIVE p AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
DIST = "pow(list_distance(a.v, b.v), 2)"
KNN = f"""{P}, k AS (SELECT i, j, d, rank FROM (SELECT a.id AS i, b.id AS j, {DIST} AS d, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS INTEGER) AS rank FROM p a, p b) WHERE rank <= {T})"""
EDGES = f"""{KNN}, u AS (SELECT i, j, d FROM k UNION ALL SELECT j, i, d FROM k), e AS (SELECT i, j, min(d) AS d FROM u GROUP BY i, j), m AS (SELECT i, avg(d) AS mean FROM u GROUP BY i)"""
AFFINITY = f"""{EDGES}, s AS (SELECT e.i, e.j, CASE WHEN a.mean * b.mean = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE exp(-d * d / (a.mean * b.mean)) END AS s FROM e JOIN m a ON a.i = e.i JOIN m b ON b.i = e.j)"""
DEGREE = f"""{AFFINITY}, g AS (SELECT i, sqrt(sum(s)) AS root FROM s GROUP BY i)"""

# Sources and projections


@query(f"{P} SELECT id, {DIGEST.format(v='v')} AS digest, CAST(len(v) AS INTEGER) AS width FROM p")
def vec_scan(spark, d):
    return embeddings(spark, d).select("id", digest(F.col("v")).alias("digest"), F.size("v").alias("width"))


@query(f"{P} SELECT id, round(list_sum(v), 6) AS total, CAST(len(v) AS INTEGER) AS width FROM p")
def csv_roundtrip(spark, d):
    lines = embeddings(spark, d).select("id", points.csv_line())
    return lines.select("id", fv.parse_line(F.col("value")).alias("v")).select("id", r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size("v").alias("width"))


@query(f"{P} SELECT min(id) AS id, {DIGEST.format(v='v')} AS digest FROM p GROUP BY v")
def distinct_vectors(spark, d):
    p = embeddings(spark, d)
    again = p.select((F.col("id") + 1000000000).alias("id"), "v")
    return points.distinct_vectors(p.unionByName(again)).select("id", digest(F.col("v")).alias("digest"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS idx FROM lineitem")
def dense_index(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return points.dense_index(t).select("l_orderkey", "l_linenumber", "idx")


@query(f"{P} SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm FROM p")
def vec_norm(spark, d):
    return embeddings(spark, d).select("id", r6(fv.norm("v")).alias("norm"))


@query(f"{P} SELECT id, round(list_sum(list_transform(v, lambda x: least(1.0, greatest(0.0, x)))), 6) AS total FROM p")
def clamp_unit(spark, d):
    return embeddings(spark, d).select("id", r6(F.aggregate(F.transform("v", fv.clamp_unit), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"{P}, h(pos, nth) AS (VALUES (3, 0), (0, 1), (3, 2)) SELECT id, nth, round(v[pos + 1], 6) AS x FROM p, h")
def column_view(spark, d):
    return embeddings(spark, d).select("id", F.posexplode(points.column_view(F.col("v"), [3, 0, 3])).alias("nth", "x")).select("id", "nth", r6(F.col("x")).alias("x"))


@query(f"{P}, x AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM p) SELECT CAST(pos - 1 AS INTEGER) AS pos, round(min(x), 6) AS low, round(max(x), 6) AS high FROM x GROUP BY pos")
def col_stats(spark, d):
    return rounded(buckets.column_stats(embeddings(spark, d), WIDTH), "low", "high")


@query("SELECT count(*) AS n, count(DISTINCT label) AS clusters FROM embeddings")
def row_counts(spark, d):
    return labelled(spark, d).agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"))


# Pairs, neighbours, graph


@query(f"{P} SELECT a.id AS i, count(*) AS n, round(sum({DIST}), 4) AS total, round(min({DIST}), 6) AS low, round(max({DIST}), 6) AS high FROM p a, p b GROUP BY a.id")
def pair_sqdist(spark, d):
    """Every point with every point; the distances of each are digested, as there are n squared."""
    found = neighbours.pair_summary(embeddings(spark, d), block=512)
    return found.select("i", "n", F.round("total", 4).alias("total"), r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query(f"{KNN} SELECT i, j, rank, round(d, 6) AS d FROM k")
def knn_t(spark, d):
    return rounded(near(spark, d), "d")


@query(f"{KNN} SELECT i, j, rank, round(d, 6) AS d FROM k")
def knn_t_blocks(spark, d):
    """The same from many small blocks."""
    return rounded(neighbours.neighbours(embeddings(spark, d), T, block=100), "d")


@query(f"{KNN} SELECT i, j, rank, round(d, 6) AS d FROM k")
def knn_t_bounds(spark, d):
    """The same by balls and triangle bounds."""
    return rounded(bounds.neighbours_by_bounds(embeddings(spark, d), T), "d")


#: Distinct line items as points of whole numbers, numbered in their order. For SQL, prices within 300 either side hold the
#: ten nearest of most; rows of which the tenth lies further off are compared with all.
ITEMS = """WITH u AS (SELECT DISTINCT round(l_quantity * 100) AS a, round(l_extendedprice * 100) AS b, round(l_discount * 100) AS c, round(l_tax * 100) AS d FROM lineitem),
p AS (SELECT row_number() OVER (ORDER BY a, b, c, d) - 1 AS id, * FROM u),
n1 AS (SELECT x.id AS i, y.id AS j, (x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2 AS d FROM p x JOIN p y ON y.b BETWEEN x.b - 30000 AND x.b + 30000),
k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM n1) WHERE rank <= 10),
far AS (SELECT p.* FROM p LEFT JOIN k1 ON k1.i = p.id AND rank = 10 WHERE k1.d IS NULL OR k1.d > 30000.0 ** 2),
n2 AS (SELECT x.id AS i, y.id AS j, (x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2 AS d FROM far x, p y),
k2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM n2) WHERE rank <= 10)"""


def items(spark, d):
    v = F.array(*(F.round(F.col(c).cast("double") * 100) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    distinct = table(spark, d, "lineitem").select(v.alias("v")).distinct()
    return points.dense_index(distinct, "v").select(F.col("idx").alias("id"), "v")


@query(f"{ITEMS} SELECT i, j, CAST(rank AS INTEGER) AS rank, d FROM k1 WHERE i NOT IN (SELECT id FROM far) UNION ALL SELECT i, j, CAST(rank AS INTEGER), d FROM k2")
def knn_lineitem(spark, d):
    """The ten nearest of every distinct line item, by balls and triangle bounds."""
    return bounds.neighbours_by_bounds(items(spark, d), T)


TERMS = """WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[^A-Za-z]+')) AS term FROM documents), c AS (SELECT doc_id AS id, term, CAST(count(*) AS DOUBLE) AS n FROM w WHERE term <> '' GROUP BY doc_id, term),
m AS (SELECT id, sum(n * n) AS m FROM c GROUP BY id), g AS (SELECT x.id AS i, y.id AS j, sum(x.n * y.n) AS g FROM c x JOIN c y USING (term) GROUP BY x.id, y.id),
s AS (SELECT a.id AS i, b.id AS j, a.m + b.m - 2 * coalesce(g.g, 0) AS d FROM m a CROSS JOIN m b LEFT JOIN g ON g.i = a.id AND g.j = b.id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY d, j) AS INTEGER) AS rank FROM s)"""


def term_points(spark, d):
    """Documents as sparse points: how often each has each term, terms numbered in their order."""
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: w != "")
    counts = settle(table(spark, d, "documents").select("doc_id", F.explode(words).alias("term")).groupBy("doc_id", "term").count())
    terms = settle(points.dense_index(counts.select("term").distinct(), "term"))
    return sparse.from_entries(counts.join(terms, "term"), "doc_id", "idx", "count", terms.count())


@query(f"{TERMS} SELECT i, j, d, rank FROM k WHERE rank <= {T}")
def knn_terms(spark, d):
    return neighbours.neighbours(term_points(spark, d), T)


@query(f"{EDGES} SELECT i, j, round(d, 6) AS d FROM e")
def sym_edges(spark, d):
    return rounded(graph.symmetric_edges(near(spark, d)), "d")


@query(f"""{KNN}, l AS (SELECT i, j FROM k WHERE rank <= 2 UNION SELECT j, i FROM k WHERE rank <= 2),
    r AS (SELECT i, i AS c FROM l UNION SELECT r.i, l.j FROM r JOIN l ON l.i = r.c) SELECT i AS id, min(c) AS component FROM r GROUP BY i""")
def graph_components(spark, d):
    return components.components(near(spark, d).where("rank <= 2"))


@query(f"{EDGES} SELECT i, round(mean, 6) AS mean FROM m")
def row_avg_dist(spark, d):
    return rounded(graph.mean_distances(near(spark, d)), "mean")


@query(f"{AFFINITY} SELECT i, j, round(s, 6) AS s FROM s")
def affinity_selftuned(spark, d):
    return rounded(graph.self_tuned_affinity(near(spark, d)), "s")


@query(f"{DEGREE} SELECT i, round(root, 6) AS root FROM g")
def degree(spark, d):
    return rounded(graph.degrees(graph.self_tuned_affinity(near(spark, d))), "root")


@query(f"{DEGREE} SELECT s.i, s.j, round(a.root * s * b.root, 6) AS w FROM s JOIN g a ON a.i = s.i JOIN g b ON b.i = s.j")
def graph_matrix(spark, d):
    return rounded(graph.graph_matrix(graph.self_tuned_affinity(near(spark, d))), "w").orderBy("i", "j")


@query(f"""{P}, z AS (SELECT id, CASE WHEN id % 7 = 0 THEN list_transform(v, lambda x: 0.0) ELSE v END AS v FROM p), n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM z)
SELECT id, {DIGEST.format(v='list_transform(v, lambda x: CASE WHEN n = 0 THEN 1.0 ELSE x / n END)')} AS digest FROM n""")
def row_normalize(spark, d):
    z = embeddings(spark, d).withColumn("v", F.when(F.col("id") % 7 == 0, F.array_repeat(F.lit(0.0), WIDTH)).otherwise(F.col("v")))
    e = z.select("id", fv.unit_row(F.col("v"), WIDTH).alias("e"))
    return e.select("id", digest(F.col("e")).alias("digest"))


# Centres and quality

CENTRES = f"{P}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM p), q AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY label, pos), c AS (SELECT label AS cluster, list(m ORDER BY pos) AS c FROM q GROUP BY label)"
SPREAD = f"{CENTRES}, t AS (SELECT label AS cluster, count(*) AS n, sum(pow(list_distance(v, c), 2)) AS total, avg(pow(list_distance(v, c), 2)) AS mean FROM p JOIN c ON cluster = label GROUP BY label)"


@query(f"{CENTRES} SELECT id, min_by(cluster, pow(list_distance(v, c), 2)) AS cluster, round(min(pow(list_distance(v, c), 2)), 6) AS d FROM p, c GROUP BY id")
def nearest_center(spark, d):
    rows = labelled(spark, d)
    near = metrics.nearest_centre(rows.select("id", "v"), metrics.centroids(rows, WIDTH))
    return rounded(near.select("id", "cluster", "d"), "d")


@query("SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark, d):
    return metrics.cluster_sizes(labelled(spark, d))


@query(f"{CENTRES} SELECT label AS cluster, CAST(pos - 1 AS INTEGER) AS pos, round(m, 6) AS m FROM q")
def centroids(spark, d):
    return rounded(metrics.centroids(labelled(spark, d), WIDTH).select("cluster", F.posexplode("c").alias("pos", "m")), "m")


@query(f"{SPREAD} SELECT cluster, n, round(total, 6) AS total, round(mean, 6) AS mean FROM t")
def dispersion(spark, d):
    return rounded(metrics.dispersion(labelled(spark, d), WIDTH), "total", "mean")


@query(f"{SPREAD} SELECT round(sum(total), 6) AS wssse FROM t")
def wssse(spark, d):
    return rounded(metrics.wssse(labelled(spark, d), WIDTH), "wssse")


@query(f"{SPREAD} SELECT round(sum(total * total) / sum(n), 4) AS ase FROM t")
def ase(spark, d):
    return metrics.ase(labelled(spark, d), WIDTH).select(F.round("ase", 4).alias("ase"))


@query(f"{SPREAD}, b AS (SELECT i.cluster, max((i.mean + j.mean) / pow(list_distance(ci.c, cj.c), 2)) AS r FROM t i JOIN t j ON i.cluster <> j.cluster JOIN c ci ON ci.cluster = i.cluster JOIN c cj ON cj.cluster = j.cluster GROUP BY i.cluster) SELECT round(avg(r), 6) AS dbi FROM b")
def dbi(spark, d):
    return rounded(metrics.dbi(labelled(spark, d), WIDTH), "dbi")


LINES = "WITH l AS (SELECT l_returnflag AS cluster, l_quantity AS a, l_extendedprice AS b, l_discount AS c, l_tax AS d FROM lineitem), m AS (SELECT cluster, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(d) AS md FROM l GROUP BY cluster)"


@query(f"{LINES} SELECT cluster, count(*) AS n, round(avg(pow(a - ma, 2) + pow(b - mb, 2) + pow(c - mc, 2) + pow(d - md, 2)), 2) AS mean FROM l JOIN m USING (cluster) GROUP BY cluster")
def dispersion_lineitem(spark, d):
    return metrics.dispersion(orders4(spark, d), 4).select("cluster", "n", F.round("mean", 2).alias("mean"))


# Hash buckets

STATS = f"{P}, x AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM p), a AS (SELECT pos, min(x) AS low, max(x) AS high FROM x GROUP BY pos), c AS (SELECT pos, low, (high - low) / 20 AS step, (high - low) / sum(high - low) OVER () AS share, sum(high - low) OVER (ORDER BY pos) / sum(high - low) OVER () AS cumulative FROM a)"
DRAWS = ", ".join(f"({b}, {u!r}::DOUBLE)" for b, u in enumerate(fv.java_doubles(3, 31)))
BITS = "(SELECT greatest(CAST(ceil(log2(count(*))) AS INTEGER), 20) FROM embeddings)"
HYPER = f"""{STATS}, u(bit, u) AS (SELECT * FROM (VALUES {DRAWS}) z(bit, u) WHERE bit < {BITS}), r AS (SELECT pos, cumulative AS high, lag(cumulative) OVER (ORDER BY pos) AS low FROM c),
f AS (SELECT bit, CAST(coalesce(min(pos), 0) AS INTEGER) AS pos FROM u LEFT JOIN r ON (pos = 0 AND u < high) OR (pos > 0 AND u >= low AND u <= high) GROUP BY bit)"""
HIST = f"""{HYPER}, bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20)),
vb AS (SELECT f.bit, p.id, coalesce((SELECT min(bin) FROM bins WHERE v[f.pos + 1] >= low + step * bin AND v[f.pos + 1] <= low + step * bin + step + CASE WHEN bin = 19 THEN 0.1 ELSE 0 END), 0) AS bin FROM p, f JOIN c ON c.pos = f.pos),
hist AS (SELECT f.bit, bins.bin, count(vb.id) AS n FROM f CROSS JOIN bins LEFT JOIN vb ON vb.bit = f.bit AND vb.bin = bins.bin GROUP BY f.bit, bins.bin)"""
LEVELS = f"""{HIST}, least AS (SELECT bit, bin, row_number() OVER (PARTITION BY bit ORDER BY bin) - 1 AS nth, count(*) OVER (PARTITION BY bit) AS ties FROM (SELECT *, min(n) OVER (PARTITION BY bit) AS m FROM hist) WHERE n = m),
th AS (SELECT f.bit, f.pos, low + bin * step AS threshold FROM least JOIN f USING (bit) JOIN c ON c.pos = f.pos WHERE nth = ties // 2)"""
SIGS = f"""{LEVELS}, sg AS (SELECT id, CAST(sum(CASE WHEN v[pos + 1] >= threshold THEN 1 << bit ELSE 0 END) AS BIGINT) AS sig FROM p, th GROUP BY id), ds AS (SELECT sig, min(id) AS first_id, count(*) AS n FROM sg GROUP BY sig)"""
# One distinct signature a step, in order of first ids; reps lists the leaders so far
LEAD = f"""{SIGS}, o AS (SELECT sig, row_number() OVER (ORDER BY first_id) AS nth FROM ds),
w AS (SELECT 0::BIGINT AS nth, CAST([] AS BIGINT[]) AS reps, NULL::BIGINT AS sig, NULL::INTEGER AS bucket
UNION ALL SELECT o.nth, CASE WHEN len(list_filter(w.reps, lambda x: bit_count(xor(x, o.sig)) <= 1)) = 0 THEN list_append(w.reps, o.sig) ELSE w.reps END, o.sig,
CASE WHEN len(list_filter(w.reps, lambda x: bit_count(xor(x, o.sig)) <= 1)) = 0 THEN CAST(len(w.reps) AS INTEGER) ELSE CAST(list_position(w.reps, list_filter(w.reps, lambda x: bit_count(xor(x, o.sig)) <= 1)[1]) - 1 AS INTEGER) END
FROM w JOIN o ON o.nth = w.nth + 1), bk AS (SELECT sg.id, sg.sig, w.bucket FROM sg JOIN w ON w.sig = sg.sig)"""
LSH_T = 10
LSH_KNN = f"""{SIGS}, ps AS (SELECT p.id, p.v, sg.sig FROM p JOIN sg ON sg.id = p.id),
k AS (SELECT i, j, d, rank FROM (SELECT a.id AS i, b.id AS j, {DIST} AS d, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS INTEGER) AS rank FROM ps a JOIN ps b ON a.sig = b.sig) WHERE rank <= {LSH_T}),
e AS (SELECT i, j, min(d) AS d FROM (SELECT i, j, d FROM k UNION ALL SELECT j, i, d FROM k) GROUP BY i, j), s AS (SELECT i, j, exp(-d * d / ({SIGMA} * {SIGMA})) AS s FROM e), g AS (SELECT i, sqrt(sum(s)) AS root FROM s GROUP BY i)"""

# The same inside the grouped buckets
BUCKET_KNN = f"""{LEAD}, ps AS (SELECT p.id, p.v, bk.bucket FROM p JOIN bk ON bk.id = p.id),
k AS (SELECT i, j, d, rank FROM (SELECT a.id AS i, b.id AS j, {DIST} AS d, CAST(row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS INTEGER) AS rank FROM ps a JOIN ps b ON a.bucket = b.bucket) WHERE rank <= {LSH_T}),
e AS (SELECT i, j, min(d) AS d FROM (SELECT i, j, d FROM k UNION ALL SELECT j, i, d FROM k) GROUP BY i, j), s AS (SELECT i, j, exp(-d * d / ({SIGMA} * {SIGMA})) AS s FROM e), g AS (SELECT i, sqrt(sum(s)) AS root FROM s GROUP BY i)"""


def spans(spark, d):
    return buckets.span_shares(buckets.column_stats(embeddings(spark, d), WIDTH))


def drawn(spark, d, s):
    return buckets.draw_features(s, buckets.bit_count(embeddings(spark, d).count()))


def signed(spark, d):
    p = settle(embeddings(spark, d))  # each bit reads a value of the vector, which is cast for each if it is not written
    return settle(buckets.signatures(p, buckets.fit_hash(p)))


@query(f"{STATS} SELECT CAST(pos AS INTEGER) AS pos, round(step, 6) AS step, round(share, 6) AS share, round(cumulative, 6) AS cumulative FROM c")
def lsh_col_cdf(spark, d):
    return rounded(spans(spark, d).drop("low"), "step", "share", "cumulative")


@query(f"{HYPER} SELECT bit, pos FROM f")
def lsh_hyperplanes(spark, d):
    return drawn(spark, d, spans(spark, d))


@query(f"{HIST} SELECT bit, bin, n FROM hist")
def lsh_histogram(spark, d):
    s = spans(spark, d)
    return buckets.histogram(embeddings(spark, d), drawn(spark, d, s), s)


@query(f"{LEVELS} SELECT bit, pos, round(threshold, 6) AS threshold FROM th")
def lsh_thresholds(spark, d):
    return rounded(buckets.fit_hash(embeddings(spark, d)), "threshold")


@query(f"{SIGS} SELECT id, sig FROM sg")
def lsh_signatures(spark, d):
    return signed(spark, d).select("id", "sig")


@query(f"{SIGS} SELECT sig, first_id, n FROM ds")
def lsh_distinct_sigs(spark, d):
    return buckets.distinct_signatures(signed(spark, d))


@query(f"{SIGS} SELECT a.sig AS s1, b.sig AS s2 FROM ds a JOIN ds b ON a.sig < b.sig AND bit_count(xor(a.sig, b.sig)) = 1")
def lsh_hamming_pairs(spark, d):
    return buckets.hamming_pairs(signed(spark, d))


@query(f"{LEAD} SELECT id, sig, bucket FROM bk")
def lsh_buckets(spark, d):
    return buckets.buckets(signed(spark, d)).select("id", "sig", "bucket")


@query(f"{LEAD} SELECT bucket, count(*) AS n FROM bk GROUP BY bucket")
def lsh_bucket_sizes(spark, d):
    return buckets.buckets(signed(spark, d)).groupBy("bucket").agg(F.count("*").alias("n"))


def lsh_near(spark, d):
    return neighbours.bucket_neighbours(signed(spark, d).select("id", "v", F.col("sig").alias("bucket")), LSH_T)


@query(f"{LSH_KNN} SELECT i, j, rank, round(d, 6) AS d FROM k")
def lsh_knn(spark, d):
    return rounded(lsh_near(spark, d), "d")


@query(f"{LSH_KNN} SELECT i, j, round(s, 6) AS s FROM s")
def lsh_affinity(spark, d):
    return rounded(graph.width_affinity(lsh_near(spark, d), SIGMA), "s")


@query(f"{LSH_KNN} SELECT s.i, s.j, round(a.root * s * b.root, 6) AS w FROM s JOIN g a ON a.i = s.i JOIN g b ON b.i = s.j")
def lsh_matrix(spark, d):
    return rounded(graph.graph_matrix(graph.width_affinity(lsh_near(spark, d), SIGMA)), "w")


def bucket_near(spark, d):
    return neighbours.bucket_neighbours(buckets.buckets(signed(spark, d)).select("id", "v", "bucket"), LSH_T)


@query(f"{BUCKET_KNN} SELECT i, j, rank, round(d, 6) AS d FROM k")
def lsh_bucket_knn(spark, d):
    return rounded(bucket_near(spark, d), "d")


@query(f"{BUCKET_KNN} SELECT i, j, round(s, 6) AS s FROM s")
def lsh_bucket_affinity(spark, d):
    return rounded(graph.width_affinity(bucket_near(spark, d), SIGMA), "s")


@query(f"{BUCKET_KNN} SELECT s.i, s.j, round(a.root * s * b.root, 6) AS w FROM s JOIN g a ON a.i = s.i JOIN g b ON b.i = s.j")
def lsh_bucket_matrix(spark, d):
    return rounded(graph.graph_matrix(graph.width_affinity(bucket_near(spark, d), SIGMA)), "w")


# Landmarks: for checking, every 50th point; the strategy itself draws them

LM_SIGMA = 8.0
LANDMARK = f"{P}, l AS (SELECT * FROM p WHERE id % 50 = 0), o AS (SELECT * FROM p WHERE id % 50 <> 0)"
LM_A = f"SELECT a.id AS i, b.id AS j, exp(-{DIST} / (2 * {LM_SIGMA} * {LM_SIGMA})) AS s FROM l a, l b"
LM_B = f"SELECT a.id AS i, b.id AS j, exp(-{DIST} / (2 * {LM_SIGMA} * {LM_SIGMA})) AS s FROM o a, l b"


def landmark_parts(spark, d):
    p = embeddings(spark, d)
    return p.where("id % 50 = 0"), p.where("id % 50 <> 0")


@query(f"{P} SELECT id, id % 5 = 0 AS landmark FROM p")
def landmark_split(spark, d):
    p = embeddings(spark, d)
    a, b = p.where("id % 5 = 0"), p.where("id % 5 <> 0")
    return a.select("id", F.lit(True).alias("landmark")).unionByName(b.select("id", F.lit(False).alias("landmark")))


@query(f"{LANDMARK} SELECT i, j, round(s, 6) AS s FROM ({LM_A})")
def landmark_a(spark, d):
    marks, _ = landmark_parts(spark, d)
    return rounded(landmarks.Landmarks.of(marks, LM_SIGMA).affinities(marks), "s")


@query(f"{LANDMARK} SELECT i, j, round(s, 6) AS s FROM ({LM_B})")
def landmark_b(spark, d):
    marks, rest = landmark_parts(spark, d)
    return rounded(landmarks.Landmarks.of(marks, LM_SIGMA).affinities(rest), "s")


@query(f"{LANDMARK}, b AS ({LM_B.replace(DIST, f'pow({DIST}, 2)')}) SELECT i, j, round(s, 6) AS s FROM b")
def landmark_b_squared(spark, d):
    """The kernel of the squared distance, squared again."""
    marks, rest = landmark_parts(spark, d)
    return rounded(landmarks.Landmarks.of(marks, LM_SIGMA, power=2).affinities(rest), "s")


@query(f"""{LANDMARK}, a AS ({LM_A}), b AS ({LM_B}) SELECT 'a' AS kind, i AS id, round(sum(s), 6) AS total FROM a GROUP BY i
UNION ALL SELECT 'b1', j, round(sum(s), 6) FROM b GROUP BY j UNION ALL SELECT 'b2', i, round(sum(s), 6) FROM b GROUP BY i""")
def landmark_sums(spark, d):
    marks, rest = landmark_parts(spark, d)
    own = landmarks.Landmarks.of(marks, LM_SIGMA)
    columns = own.column_sums(rest).select(F.posexplode("row").alias("n", "total")).select(F.element_at(F.lit(own.ids.tolist()), F.col("n") + 1).alias("id"), "total")
    parts = (("a", own.row_sums(marks)), ("b1", columns), ("b2", own.row_sums(rest)))
    out = [df.select(F.lit(kind).alias("kind"), "id", r6(F.col("total")).alias("total")) for kind, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"{LANDMARK}, b AS ({LM_B}) SELECT x.j AS m, y.j AS n, round(sum(x.s * y.s), 6) AS p FROM b x JOIN b y ON x.i = y.i GROUP BY x.j, y.j")
def landmark_outer(spark, d):
    marks, rest = landmark_parts(spark, d)
    own = landmarks.Landmarks.of(marks, LM_SIGMA)
    name = lambda c: F.element_at(F.lit(own.ids.tolist()), F.col(c).cast("int") + 1)
    return own.outer_products(rest).select("m", F.posexplode("row").alias("n", "p")).select(name("m").alias("m"), name("n").alias("n"), r6(F.col("p")).alias("p"))


@query(f"{P}, k AS (SELECT v, arg_min(label, id) AS cluster FROM p GROUP BY v) SELECT p.id, k.cluster FROM p JOIN k ON k.v = p.v UNION ALL SELECT -1 - p.id, k.cluster FROM p JOIN k ON k.v = p.v")
def predict_lookup(spark, d):
    """Every vector looked up, in a table that has each twice: the repeat, of a larger id and another cluster, loses. Rows asked twice have ids below 0."""
    rows = labelled(spark, d)
    again = rows.select((F.col("id") + 1000000000).alias("id"), "v", (F.col("cluster") + 1).alias("cluster"))
    trained = rows.unionByName(again)
    found = clustering.ClusterModel([], trained, trained).predict(rows).distinct()
    asked = rows.select("id", "v").unionByName(rows.select((-1 - F.col("id")).alias("id"), "v"))
    return asked.join(found, "v").select("id", "cluster")


@query(f"{EDGES} SELECT e.i, e.j, CAST(row_number() OVER (PARTITION BY e.i ORDER BY e.j) AS INTEGER) AS nth FROM e")
def sorted_rows(spark, d):
    """Entries of each sparse row numbered by column."""
    e = graph.symmetric_edges(near(spark, d))
    return e.select("i", "j", F.row_number().over(Window.partitionBy("i").orderBy("j")).alias("nth"))


@query(f"{SPREAD} SELECT id, label AS cluster, round(pow(list_distance(v, c), 2), 6) AS d FROM p JOIN c ON cluster = label")
def centroid_distance(spark, d):
    rows = labelled(spark, d)
    return rounded(rows.join(metrics.centroids(rows, WIDTH), "cluster").select("id", "cluster", fv.squared_distance("v", "c", WIDTH).alias("d")), "d")


from . import strategies  # noqa: E402, F401  (registers its queries here)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
