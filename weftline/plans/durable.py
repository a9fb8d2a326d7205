"""Cut a plan with a table written to the cluster's shared folder.

Iterative operators must not keep growing lineage, and executors may be lost at
any time, so a cut is a real table in the folder that ``spark.checkpoint.dir``
names. A written table is computed once (``checkpoint()`` computes its last
stage twice) and is columnar when read again. Tables that a loop or an operator has used up are
deleted at once (``release``); those that a returned frame still reads go with the application.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_dirs: list[str] = []
_marked: set[str] = set()


@atexit.register
def _drop_local() -> None:
    for d in _local_dirs:
        shutil.rmtree(d, ignore_errors=True)


def shared_root(spark: SparkSession) -> str:
    """Folder for materialised tables; a temporary one only in local mode with nothing configured."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="weftline-")
        _local_dirs.append(root)
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/weftline-{sc.applicationId}"


def filesystem(spark: SparkSession, path: str) -> tuple:
    """(file system, path) objects of a path."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system has the path. A fault of the file system is an error, not a "no"."""
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def has_files(spark: SparkSession, pattern: str) -> bool:
    """Whether any path matches the pattern."""
    fs, p = filesystem(spark, pattern)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the application's own folder of the shared folder; the folder is deleted when the session's JVM ends."""
    root = shared_root(spark)
    if root not in _marked:
        fs, p = filesystem(spark, root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _marked.add(root)
    return f"{root}/{name}"


def materialize(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it."""
    spark = df.sparkSession
    path = scratch(spark, f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def materialize_marked(df: DataFrame, columns: list[str], tag: str = "cut") -> tuple[DataFrame, tuple]:
    """``materialize`` with a mark of the rows as a set (count and sum of hashes of ``columns``), taken while they are written."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("h")), tag)
    return out, (seen.get["n"], seen.get["h"])


def release(*frames: DataFrame | None) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_weftline_path", None)
        if path:
            fs, p = filesystem(df.sparkSession, path)
            fs.delete(p, True)
