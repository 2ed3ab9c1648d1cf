"""Cutting lineage in the shared folder, and shipping the package to executors.

Staged tables are gone with the session at the latest; what a later staged table has replaced is dropped at once.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session on a local master has none, a temporary one is made and set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, place = _place(spark, path)
    system.mkdirs(place)
    system.deleteOnExit(place)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that later steps survive lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in staged:
        path = getattr(df, "_staged_at", None)
        if path:
            system, place = _place(df.sparkSession, path)
            system.delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, however the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="siftwell-py-")) / "siftwell.zip"
    with zipfile.ZipFile(out, "w") as archive:
        for p in sorted(root.rglob("*.py")):
            archive.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path may be any that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
