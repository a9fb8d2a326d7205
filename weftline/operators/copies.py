"""Copies by content: templates, trusted labels, canonical rows, linked designs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import connected_components

#: Designs that share a product frame before it counts as a banner.
TEMPLATE_DESIGNS = 4


def annotate_copies(df: DataFrame, content: str = "content_md5", design: str = "design_id", category: str = "category_raw", branch: str = "branch", item: str = "sku_id", order: str = "order_idx", key: str = "image_id", template_designs: int = TEMPLATE_DESIGNS, product: str = "product") -> DataFrame:
    """Add ``dup_designs``, ``is_template``, ``label_ok``, ``is_canonical``.

    A content found in several categories, or as product frame under ``template_designs`` designs or
    more, is a template; a label holds if only one design has the content; the first row by item,
    branch, order and key is canonical. All facts of a content come from one two-level aggregate (first per content, design and category,
    then per content) and are joined back, so a banner in a third of all rows is no hot window.
    Rows with NULL content get NULL counts, no template, no label and are not canonical.
    """
    combinations = df.filter(F.col(content).isNotNull()).groupBy(F.col(content).alias("__c1"), F.col(design).alias("__d"), F.col(category).alias("__k")).agg(F.min(F.struct(item, branch, order, key)).alias("__first"))
    facts = combinations.groupBy("__c1").agg(F.countDistinct("__d").alias("dup_designs"), F.countDistinct("__k").alias("__cats"), F.min("__first").alias("__first"))
    out = df.join(facts, F.col(content) == F.col("__c1"), "left")
    template = (F.col("__cats") > 1) | ((F.col(branch) == product) & (F.col("dup_designs") >= template_designs))
    out = out.withColumn("is_template", F.coalesce(template, F.lit(False)))
    out = out.withColumn("label_ok", F.coalesce(F.col("dup_designs") == 1, F.lit(False)) & ~F.col("is_template"))
    return out.withColumn("is_canonical", F.coalesce(F.col("__first")[key] == F.col(key), F.lit(False))).drop("__c1", "__cats", "__first")


def linked_designs(annotated: DataFrame, content: str = "content_md5", design: str = "design_id", branch: str = "branch", product: str = "product") -> DataFrame:
    """``design_id``, ``split_group``: designs joined through shared product frames that are no templates.

    Each content links its smallest design with its others (a star, never all pairs);
    designs without shared content are groups of their own; the group is named by its smallest design.
    """
    base = annotated.filter((F.col(branch) == product) & ~F.col("is_template") & F.col(content).isNotNull() & F.col(design).isNotNull())
    one = base.select(F.col(content).alias("c"), F.col(design).alias("d")).distinct()
    star = one.join(one.groupBy(F.col("c").alias("c2")).agg(F.min("d").alias("lo")), F.col("c") == F.col("c2")).filter("d <> lo").select("lo", "d")
    out = connected_components(star, "lo", "d", vertices=annotated.select(design), vertex=design)
    return out.select(F.col("vertex").alias(design), F.col("component").alias("split_group"))
