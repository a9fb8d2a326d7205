"""Queries of the llm subpackage: name -> callable(spark, dir), and SQL where it can say the same."""

from __future__ import annotations

from weftline.llm import designs, leakage, near_images, packing, splits, subset, truncation
from weftline.llm.oracles import SQL

#: Share of the training pairs that p1_subset chooses.
SUBSET_SHARE = 0.05


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries():
    return {
        "p1_subset": lambda s, d: subset.varied_subset(_t(s, d, "manifest_pairs"), share=SUBSET_SHARE),
        "p2_found": lambda s, d: designs.design_groups(_t(s, d, "design_links")),
        "p2_split_groups": lambda s, d: designs.consolidated_split_groups(_t(s, d, "manifest_sku"), _t(s, d, "design_links")),
        "p3_found": lambda s, d: near_images.found_overlaps(_t(s, d, "manifest_images")),
        "p3_report": lambda s, d: near_images.overlap_report(_t(s, d, "manifest_images")),
        "p4_found": lambda s, d: splits.broken_groups(_t(s, d, "manifest_sku"), _t(s, d, "design_links")),
        "p4_assign": lambda s, d: splits.assign_splits(_t(s, d, "manifest_sku"), _t(s, d, "design_links")),
        "p6_found": lambda s, d: near_images.near_image_groups(_t(s, d, "manifest_images")),
        "p7_sequences": lambda s, d: packing.pack_documents(_t(s, d, "documents")),
        "p7_report": lambda s, d: packing.packing_report(packing.pack_documents(_t(s, d, "documents"))),
        "p8_found": lambda s, d: leakage.leaked_items(_t(s, d, "documents"), _t(s, d, "eval_items")).select("doc_id", "item_id"),
        "p8_report": lambda s, d: leakage.leak_report(_t(s, d, "documents"), _t(s, d, "eval_items")),
        "p9_found": lambda s, d: truncation.truncated_documents(_t(s, d, "documents")).filter("truncated").select("doc_id"),
        "p9_report": lambda s, d: truncation.truncation_report(_t(s, d, "documents")),
        "p9_limits": lambda s, d: truncation.exposed_limits(truncation.text_tails(_t(s, d, "documents"))).drop("m"),
    }


def oracle_sql():
    return SQL
