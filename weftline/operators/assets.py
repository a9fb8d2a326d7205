"""Ordering and inventory of items and their frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.ids import leading_number
from weftline.operators.ranking import global_index
from weftline.plans.durable import materialize


def order_assets(df: DataFrame, item: str = "sku_id", branch: str = "branch", path: str = "rel_path", product: str = "product") -> DataFrame:
    """``order_idx`` (from 0) and ``is_last_product`` of every frame of an item's branch.

    Frames are ordered by the number their file name starts with, then by name, then by path. The
    order is global and range-partitioned, and each branch's first and last places are aggregates, so an
    item with a third of all frames isn't one window. NULL items and branches are groups of their own.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    rows = materialize(global_index(df.withColumn("__n", leading_number(name)).withColumn("__f", name), [item, branch, "__n", "__f", path], "__i"), "ordered")
    ends = rows.groupBy(F.col(item).alias("__a"), F.col(branch).alias("__b")).agg(F.min("__i").alias("__lo"), F.max("__i").alias("__hi"))
    out = rows.join(ends, F.col(item).eqNullSafe(F.col("__a")) & F.col(branch).eqNullSafe(F.col("__b"))).withColumn("order_idx", (F.col("__i") - F.col("__lo")).cast("int"))
    last = (F.col("__i") == F.col("__hi")) & F.coalesce(F.col(branch) == product, F.lit(False))
    return out.withColumn("is_last_product", last).drop("__n", "__f", "__i", "__a", "__b", "__lo", "__hi")


def count_variants(df: DataFrame, design: str = "design_id", out: str = "design_variants") -> DataFrame:
    """Rows per design beside every row: pre-aggregated and joined back, so a hot design is never one window. NULL designs get NULL."""
    n = df.groupBy(F.col(design).alias("__d")).agg(F.count(F.lit(1)).alias(out)).filter("__d is not null")
    return df.join(n, F.col(design) == F.col("__d"), "left").drop("__d")


def inventory(items: DataFrame, frames: DataFrame, item: str = "sku_id", group: str = "category_group") -> DataFrame:
    """Items and frames per group; frames are counted per item before the join."""
    per = frames.groupBy(F.col(item).alias("__i")).agg(F.count(F.lit(1)).alias("__n"))
    both = items.select(item, group).join(per, F.col(item) == F.col("__i"), "left")
    return both.groupBy(group).agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("__n"), F.lit(0)).alias("frames"))


def health(frames: DataFrame, checks: dict[str, str]) -> DataFrame:
    """One row: for each check (name -> SQL condition) the number of rows that meet it."""
    return frames.agg(*[F.coalesce(F.sum(F.when(F.expr(c), 1)), F.lit(0)).cast("long").alias(n) for n, c in checks.items()])


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: distinct known values of each column."""
    return df.agg(*[F.countDistinct(c).alias(c) for c in columns])
