"""One row per entity out of repeated rows, in which later ones fill what earlier ones lacked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.nulls import nan_to_null


def consolidate(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """One row per ``key`` with, for each column, the greatest value any of its rows has.

    Rows of a key are expected to agree wherever both are known; NaN counts as
    unknown. A map-side aggregate, so a key repeated in a third of all rows is no hot spot.
    NULL keys are dropped.
    """
    columns = columns or [c for c in df.columns if c != key]
    return nan_to_null(df.select(key, *columns)).filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(c) for c in columns])


def frames(images: DataFrame) -> DataFrame:
    """One row per frame; ``split`` trimmed and in lower case; unread frames keep NULL measures."""
    c = ["sku_id", "branch", "order_idx", "is_last_product", "rel_path", "width", "height", "file_size", "corrupt", "read_ok", "sharpness", "white_frac", "phash", "content_md5"]
    return consolidate(images.withColumn("split", F.lower(F.trim("split"))), "image_id", [*c, "split"])


def items(sku: DataFrame) -> DataFrame:
    """One row per item; ``category_group`` and ``split`` trimmed and in lower case."""
    fold = {x: F.lower(F.trim(x)) for x in ("category_group", "split")}
    return consolidate(sku.withColumns(fold), "sku_id", ["folder", "title_base", "variant_no", "design_id", "category_raw", "category_group", "n_product", "n_review", "split"])


def pairs(table: DataFrame) -> DataFrame:
    """One row per garment-person pair; ``category_group`` and ``split`` in one spelling, NaN as NULL."""
    fold = {x: F.lower(F.trim(x)) for x in ("category_group", "split")}
    return consolidate(table.withColumns(fold), "pair_id", [c for c in table.columns if c not in ("pair_id", "built_at")])
