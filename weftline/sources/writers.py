"""Sinks: staged table replacement, stage outputs, small documents and logs. All go through the cluster's file system."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.durable import exists, filesystem


def _swap(spark: SparkSession, staged: str, path: str) -> None:
    """Put what was written to ``staged`` in the place of ``path``; on failure ``path`` is what it was before."""
    fs, new = filesystem(spark, staged)
    at = lambda p: filesystem(spark, p)[1]
    old = f"{path}.old-{uuid.uuid4().hex}"
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        fs.delete(new, True)
        raise OSError(f"{path} can't be moved aside; it is unchanged")
    try:
        moved = fs.rename(new, at(path))
    except Exception:  # noqa: BLE001 - whatever the file system raises, the old table comes back
        moved = False
    if not moved:
        if had and not fs.rename(at(old), at(path)):
            raise OSError(f"{path} can't be replaced; its rows are in {old}")
        fs.delete(new, True)
        raise OSError(f"{path} can't be replaced; it is unchanged")
    if had:
        fs.delete(at(old), True)


def replace_table(df: DataFrame, path: str, partial: bool = False) -> None:
    """Write a table beside ``path`` and swap it in, so a table may be replaced by a plan that reads it.

    Both renames are checked: if one fails, the old table stays or comes back, and an error says so.
    ``partial`` marks a debug run over some rows; it must not replace a table and is an error.
    """
    if partial:
        raise ValueError("a partial run must not replace a table")
    staged = f"{path}.tmp-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    _swap(df.sparkSession, staged, path)


def write_stage(df: DataFrame, path: str) -> None:
    """Add payloads of a stage, as a folder of their own: shards that run side by side don't meet, and a failed run leaves no rows."""
    df.write.parquet(f"{path}/run={uuid.uuid4().hex}")


def replace_stage_rows(df: DataFrame, keys: DataFrame, path: str, key: str = "image_id") -> None:
    """Put ``df`` in the place of a stage's rows of ``keys``; rows of other keys stay. No other run may write the stage at the same time."""
    spark = df.sparkSession
    if exists(spark, path):
        kept = read_stage(spark, path, df.schema[key].dataType.simpleString(), df.schema["payload"].dataType.simpleString(), key)
        df = kept.join(keys.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti").unionByName(df)
    staged = f"{path}.tmp-{uuid.uuid4().hex}"
    df.write.parquet(f"{staged}/run={uuid.uuid4().hex}")
    _swap(spark, staged, path)


def read_stage(spark: SparkSession, path: str, key_type: str, payload: str, key: str = "image_id") -> DataFrame:
    """Rows of a stage; a stage that no run has written yet has none. A fault of the file system is an error, not an empty stage."""
    schema = f"{key} {key_type}, payload {payload}"
    return spark.read.schema(schema).parquet(path).select(key, "payload") if exists(spark, path) else spark.createDataFrame([], schema)


def write_text(pieces: Iterable[str], path: str, spark: SparkSession | None = None) -> None:
    """A document, streamed in pieces to a file beside ``path`` and renamed; never held as a whole."""
    _write_file((p.encode() for p in pieces), path, spark)


def _write_file(pieces: Iterable[bytes], path: str, spark: SparkSession | None) -> None:
    spark = spark or SparkSession.active()
    staged = f"{path}.tmp-{uuid.uuid4().hex}"
    fs, new = filesystem(spark, staged)
    if fs.getScheme() == "file":
        fs = fs.getRawFileSystem()  # without checksum files, which other programs that write here wouldn't keep
    out = fs.create(new, True)
    held: list[bytes] = []
    size = 0
    try:
        for p in pieces:
            held.append(p)
            size += len(p)
            if size > 1 << 20:
                out.write(bytearray(b"".join(held)))
                held, size = [], 0
        out.write(bytearray(b"".join(held)))
    except BaseException:
        out.close()
        fs.delete(new, False)
        raise
    out.close()
    _swap(spark, staged, path)


def write_bytes(content: bytes, path: str, spark: SparkSession | None = None) -> None:
    """A small binary file, such as a picture."""
    _write_file([content], path, spark)


def write_json(payload: dict, path: str, spark: SparkSession | None = None) -> None:
    """A small document, keys sorted."""
    write_text([json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True)], path, spark)


def append_log(record: dict, path: str, spark: SparkSession | None = None) -> None:
    """One JSON line more in a run's log. A log is a folder of lines or a file; object stores can't append, so a file is written anew."""
    spark = spark or SparkSession.active()
    before = []
    if exists(spark, path):
        before = [r["value"] + "\n" for r in spark.read.option("wholetext", False).text(path).collect()]  # a log of one run
    write_text([*before, json.dumps(record, ensure_ascii=False) + "\n"], path, spark)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
