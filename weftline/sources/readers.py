"""Readers with fixed schemas; a missing file is an error that says what to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.nulls import nan_to_null
from weftline.operators.labeling import merge_labels

LABELS = "image_id string, rel_path string, category_group string, label string, batch string"
METRICS = "pair_id string, category_group string, ssim double, lpips double, l1_mask double, lpips_mask double"
LOG = "step long, loss double, loss_masked double, lr double, hours double"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with NaN as NULL."""
    return nan_to_null(spark.read.parquet(path))


def read_labels(spark: SparkSession, pattern: str) -> DataFrame:
    """All label files of a pattern; of a frame labelled twice the first file by name wins."""
    rows = spark.read.schema(LABELS).option("header", True).csv(pattern)
    return merge_labels(rows.withColumn("file", F.col("_metadata.file_name")), order=["file"]).drop("file")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.schema(METRICS).option("header", True).option("nanValue", "nan").csv(path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines log; blank and broken lines are dropped."""
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).filter("step is not null")
