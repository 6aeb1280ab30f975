"""Cutting lineage: results that several later steps read are written once to the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_temporary: list[str] = []
_shipped: set[str] = set()
_made: dict[str, list[str]] = {}
_path_of: WeakKeyDictionary = WeakKeyDictionary()
_tables: dict[str, str] = {}  # names of bucketed tables by path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Python workers import the functions they run, and a cluster's executors have no copy of the repository.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="affinigraph-")  # on the driver; Spark serves the file from there
    archive = os.path.join(folder, "affinigraph_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what spark.checkpoint.dir or SparkContext.setCheckpointDir names.

    A local session without either gets a temporary one; on a cluster executors would each write to their own disk, so
    there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _temporary:
        _temporary.append(tempfile.mkdtemp(prefix="affinigraph-"))
        atexit.register(shutil.rmtree, _temporary[0], ignore_errors=True)
    return "file://" + _temporary[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the storage that all executors share; clean_up() deletes it."""
    path = f"{shared_folder(spark)}/affinigraph/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage through Hadoop's file system."""
    made = _made.get(spark.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Call it when results have been written."""
    for path in list(_made.get(spark.sparkContext.applicationId, [])):
        drop_path(spark, path)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """The rows of ``df``, written to the shared folder and read from there: lineage ends, and a lost executor costs nothing."""
    ship(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def once(df: DataFrame) -> DataFrame:
    """What settle() wrote as it is, other rows settled: for what a step reads more than once."""
    return df if df in _path_of else settle(df)


def settle_by(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """As settle(), in a table of ``parts`` buckets by ``keys``: the rows move once, and joins on the keys read them where they
    are, however often they are joined. The keys of a bucket share one task, so a hot key must be salted first."""
    ship(df.sparkSession)
    path = new_path(df.sparkSession, "bucketed")
    name = f"affinigraph_{uuid.uuid4().hex}"
    _tables[path] = name
    df.repartition(parts, *keys).write.option("compression", "zstd").option("path", path).bucketBy(parts, *keys).format("parquet").saveAsTable(name)
    out = df.sparkSession.table(name)
    _path_of[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that no later step reads, as those of past rounds."""
    for t in tables:
        path = _path_of.pop(t, None)
        if path:
            drop_path(t.sparkSession, path)
