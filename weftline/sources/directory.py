"""A lake of item folders: frames, header probes, metadata files."""

from __future__ import annotations

import csv
import io
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.ids import nfc, short_id
from weftline.operators.assets import order_assets


def image_size(head: bytes | None) -> tuple[int, int]:
    """(width, height) out of the first bytes of a WebP or PNG file; (-1, -1) if they can't be read."""
    try:
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            kind, body = head[12:16], head[20:]
            if kind == b"VP8X":
                return 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
            if kind == b"VP8L" and body[0] == 0x2F:
                bits = int.from_bytes(body[1:5], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
                w, h = struct.unpack("<HH", body[6:10])
                return w & 0x3FFF, h & 0x3FFF
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", head[16:24])
    except (TypeError, IndexError, struct.error):
        pass
    return -1, -1


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def _sizes(head: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_size(None if h is None else bytes(h)) for h in head], columns=["width", "height"])


def probe_headers(df: DataFrame, content: str = "content") -> DataFrame:
    """``width``, ``height`` (-1 when unreadable) and ``corrupt`` of each frame. Only the first 64 bytes reach Python."""
    d = df.withColumn("__s", _sizes(F.substring(content, 1, 64)))
    return d.withColumn("width", F.col("__s.width")).withColumn("height", F.col("__s.height")).withColumn("corrupt", F.col("width") < 0).drop("__s")


def scan_frames(spark: SparkSession, root: str, branches: dict[str, str], pattern: str = "*.webp", inventory: DataFrame | None = None) -> DataFrame:
    """One row per frame below ``root/category/folder/branch/``: ids, branch, order, size of file and picture.

    ``branches``: folder name -> branch name. Files elsewhere are left out. Bytes are read for the header only.
    Spark's file sources skip files of zero length; an ``inventory`` of the lake (``rel_path``, ``length``, as object
    stores give one) adds those as corrupt frames.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    rows = files.select(nfc(_relative("path", root)).alias("rel_path"), F.col("length").alias("file_size"), "content")
    if inventory is not None:
        have = rows.select(F.col("rel_path").alias("__r"))
        more = inventory.select(nfc(F.col("rel_path")).alias("rel_path"), F.col("length").cast("long").alias("file_size"), F.lit(None).cast("binary").alias("content"))
        rows = rows.unionByName(more.join(have, F.col("rel_path") == F.col("__r"), "left_anti"))
    p = F.split("rel_path", "/")
    names = F.create_map(*[F.lit(nfc_text(x)) for kv in branches.items() for x in kv])
    rows = rows.filter(F.size(p) == 4).withColumn("branch", F.try_element_at(names, p[2])).filter("branch is not null")
    rows = rows.withColumn("sku_id", short_id(F.concat_ws("/", p[0], p[1]))).withColumn("image_id", short_id("rel_path"))
    return order_assets(probe_headers(rows).drop("content"))


def _relative(path: str, root: str):
    """Path below the root; file sources give URIs."""
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), r"^.*?" + _escaped(root.rstrip("/")) + "/", "")


def nfc_text(x: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", x)


def _escaped(x: str) -> str:
    import re

    return re.escape(x)


def scan_items(spark: SparkSession, root: str, info: str = "info.csv") -> DataFrame:
    """One row per item folder that has an info file: ``sku_id``, ``rel_dir``, ``category_raw``, ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", info).load(root)
    rel = _relative("path", root)
    rows = files.select(nfc(rel).alias("r")).withColumn("p", F.split("r", "/")).filter(F.size("p") == 3)
    rows = rows.select(F.concat_ws("/", F.col("p")[0], F.col("p")[1]).alias("rel_dir"), F.col("p")[0].alias("category_raw"), F.col("p")[1].alias("folder"))
    return rows.withColumn("sku_id", short_id("rel_dir"))


def info_pairs(text: str | None) -> list[tuple[int, str, str]]:
    """(position, key, value) of an info file: CSV with quotes, line breaks inside quotes included; further cells belong to the value."""
    found = enumerate(csv.reader(io.StringIO((text or "").removeprefix("\ufeff"), newline="")))
    return [(at, cells[0].strip(), value) for at, cells in found if len(cells) > 1 and cells[0] != "key" and cells[0].strip() and (value := ",".join(cells[1:]).strip())]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])))
def _pairs(text: pd.Series) -> pd.Series:
    return text.map(info_pairs)


def read_info(spark: SparkSession, root: str, info: str = "info.csv") -> DataFrame:
    """``rel_dir``, ``pos``, ``key``, ``value`` rows of the items' info files.

    Lines are key, value; a value cut by commas is joined again; the header ``key`` and lines without key or value are left out.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", info).option("wholetext", True).text(root).select("value", F.col("_metadata.file_path").alias("path"))
    rows = files.select(nfc(F.regexp_replace(_relative("path", root), "/[^/]*$", "")).alias("rel_dir"), F.explode(_pairs("value")).alias("x"))
    return rows.select("rel_dir", "x.pos", "x.key", "x.value")
