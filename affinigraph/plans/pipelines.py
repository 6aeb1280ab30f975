"""Command-line pipelines: python -m affinigraph.plans.pipelines NAME ARGUMENT...

knn      MASTER PATH PARTITIONS SPARSITY SIGMA K     (SIGMA is accepted and has no effect)
lsh      MASTER PATH PARTITIONS SIGMA K SHARE
landmark MASTER PATH PARTITIONS SHARE SIGMA K
kmeans   MASTER PATH PARTITIONS K
generate MASTER FOLDER PARTITIONS RECORDS FEATURES TABLE CLUSTERS SCATTER
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, metrics
from ..sources import datagen, points
from ..sources.store import settle


def load(spark: SparkSession, path: str, parts: int) -> DataFrame:
    """Distinct vectors of a CSV file or folder, numbered in their own order."""
    v = points.read_csv_vectors(spark, path).distinct()
    return settle(points.dense_index(v, "v").select(F.col("idx").alias("id"), "v").repartition(parts, "id"))


def report(strategy, data: DataFrame) -> dict:
    """Fits and measures: centres, sizes, seconds and the quality figures."""
    began = time.perf_counter()
    model = strategy.fit(data)
    assigned = settle(model.predict_all())
    sizes = {r.cluster: r.n for r in metrics.cluster_sizes(assigned).collect()}
    seconds = time.perf_counter() - began
    out = {"centers": model.centers, "sizes": sizes, "seconds": seconds}
    for f in (metrics.ase, metrics.dbi, metrics.wssse):
        out[f.__name__] = f(assigned).first()[0]
    return out


def run_knn_graph(spark: SparkSession, path: str, parts: int, sparsity: float, k: int) -> dict:
    return report(clustering.KnnGraphClustering(k=k, sparsity=sparsity), load(spark, path, parts))


def run_lsh(spark: SparkSession, path: str, parts: int, sigma: float, k: int, share: float) -> dict:
    return report(clustering.LshGraphClustering(k=k, sigma=sigma, share=share), load(spark, path, parts))


def run_landmark(spark: SparkSession, path: str, parts: int, share: float, sigma: float, k: int) -> dict:
    return report(clustering.LandmarkGraphClustering(k=k, share=share, sigma=sigma), load(spark, path, parts))


def run_kmeans(spark: SparkSession, path: str, parts: int, k: int) -> dict:
    return report(clustering.PlainKMeans(k=k), load(spark, path, parts))


def generate(spark: SparkSession, folder: str, parts: int, records: int, features: int, table: str, clusters: int, scatter: float) -> str:
    """Writes points as CSV lines, over what is there."""
    path = f"{folder.rstrip('/')}/{table}"
    points.write_csv_vectors(datagen.clustered_points(spark, records, features, clusters, scatter, parts), path)
    return path


#: Name: function and the types of what follows MASTER; None skips an argument.
COMMANDS = {
    "knn": (run_knn_graph, (str, int, float, None, int)),
    "lsh": (run_lsh, (str, int, float, int, float)),
    "landmark": (run_landmark, (str, int, float, float, int)),
    "kmeans": (run_kmeans, (str, int, int)),
    "generate": (generate, (str, int, int, int, str, int, float)),
}


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in COMMANDS or len(argv) != 2 + len(COMMANDS[argv[0]][1]):
        print(__doc__, file=sys.stderr)
        return 2
    f, kinds = COMMANDS[argv[0]]
    spark = SparkSession.builder.master(argv[1]).appName(f"affinigraph {argv[0]}").getOrCreate()
    print(f(spark, *(kind(a) for kind, a in zip(kinds, argv[2:], strict=True) if kind)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
