"""Design links of the garment tables: one spelling per design, groups of linked designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import hash_to_min

_BLANKS = r"[\s\u00A0\u2000-\u200B\u202F\u2060\u3000\uFEFF]+"


def design_spelling(c: Column | str) -> Column:
    """Lower case, ё as е, single inner blanks, no outer blanks; blank text becomes NULL."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(F.lower(c), r"ё|е\u0308", "е")
    s = F.trim(F.regexp_replace(s, _BLANKS, " "))
    return F.when(s != "", s)


def same_links(links: DataFrame, a: str = "design_a", b: str = "design_b", verdict: str = "verdict") -> DataFrame:
    """The links with verdict ``same`` and both sides present, in one spelling: ``a``, ``b``."""
    return links.filter(F.col(verdict) == "same").select(design_spelling(a).alias("a"), design_spelling(b).alias("b")).filter("a is not null and b is not null")


def design_groups(links: DataFrame) -> DataFrame:
    """Each linked design with its group's smallest design: ``design_id``, ``group_id``.

    Designs linked only with themselves don't appear. Missing sides, NULL
    verdicts and other verdicts don't link; empty tables give no rows.
    """
    return hash_to_min(same_links(links), "a", "b").select(F.col("vertex").alias("design_id"), "group_id")


def consolidated_split_groups(designs: DataFrame, links: DataFrame, design: str = "design_id") -> DataFrame:
    """Every design of ``designs`` with its consolidated ``split_group`` (its own name when it has no link)."""
    known = designs.select(design_spelling(design).alias("design_id")).filter("design_id is not null").distinct()
    groups = design_groups(links).select(F.col("design_id").alias("linked"), "group_id")
    return known.join(groups, F.col("design_id") == F.col("linked"), "left").select("design_id", F.coalesce("group_id", "design_id").alias("split_group"))
