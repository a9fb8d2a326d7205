"""Stratified splits by group, and checks that nothing leaks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.ids import hash_rank
from weftline.operators.ranking import global_index
from weftline.plans.bounded import small_side
from weftline.sources.writers import write_text

SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}


def group_mode(items: DataFrame, group: str = "split_group", category: str = "category_group") -> DataFrame:
    """Most frequent category of each group (ties: the smallest) and the group's rows ``n_sku``. NULL groups are dropped; a NULL category counts only if it is the only one."""
    n = items.filter(F.col(group).isNotNull()).groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(F.col(category).isNull().alias("none"), (-F.col("n")).alias("n"), F.col(category).alias("value")))
    return n.groupBy(group).agg(best.alias("b"), F.sum("n").alias("n_sku")).select(group, F.col("b.value").alias(category), "n_sku")


def stratified_splits(groups: DataFrame, group: str = "split_group", stratum: str = "category_group", seed: int = 20260906, shares: Mapping[str, float] | None = None, rank: Column | None = None) -> DataFrame:
    """``split`` of every group by its place in its stratum.

    Groups of a stratum are ordered by a hash of (seed, name), so the result doesn't depend
    on row order; place (i + 0.5) / n falls into the cumulative shares. The order is global and
    range-partitioned: a stratum with a third of all groups isn't one window.
    """
    shares = dict(shares or SHARES)
    rank = hash_rank(group, seed) if rank is None else rank
    s = F.coalesce(F.col(stratum), F.lit(""))
    rows = global_index(groups.withColumn("__s", s).withColumn("__r", rank), ["__s", "__r", group], "__i")
    size = rows.groupBy(F.col("__s").alias("__s2")).agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    placed = rows.join(small_side(size), F.col("__s") == F.col("__s2"))
    place = (F.col("__i") - F.col("__first") + 0.5) / F.col("__n")
    split, acc = F.lit(next(iter(shares))), 0.0
    for name, share in shares.items():
        split = F.when((place >= acc) & (place < acc + share), name).otherwise(split)
        acc += share
    return placed.withColumn("split", split).drop("__s", "__s2", "__r", "__i", "__n", "__first")


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def leak_check(df: DataFrame, content: str = "content_md5", split: str = "split") -> DataFrame:
    """One row: contents that stand in several splits, and the rows that have them. NULL contents and splits don't count as such."""
    per = df.filter(F.col(content).isNotNull()).groupBy(content, split).agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy(content).agg(F.count(split).alias("splits"), F.sum("n").alias("rows")).filter("splits > 1")
    return per.agg(F.count(F.lit(1)).alias("contents_in_several_splits"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_affected"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys that both tables have."""
    return a.select(key).filter(F.col(key).isNotNull()).intersect(b.select(key))


def certified_json(groups: DataFrame, path: str | None = None, group: str = "split_group", split: str = "split", **facts) -> dict:
    """Assignment with its own sha256 as a JSON document (keys sorted), streamed to ``path`` if given; returns it without the assignment.

    The hash is that of the same document without the hash, in one line, as ``json.dumps`` with sorted keys writes it. Groups are sorted by
    Spark and pass the driver one partition at a time, so a document of any size can be written. NULL groups are left out.
    """
    counts = {r[0]: r[1] for r in groups.filter(F.col(group).isNotNull()).groupBy(split).agg(F.count(F.lit(1))).collect()}
    rows = groups.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.max(split).alias("s"))
    body = {**facts, "n_groups": sum(counts.values()), "counts": counts}
    sha = hashlib.sha256()
    show = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True)

    def pieces():
        mark = "{"
        for k in sorted([*body, "assignment", "content_sha256"]):
            if k == "content_sha256":
                continue
            sha.update(f"{'{' if mark == '{' else ', '}{show(k)}: ".encode())
            yield f"{mark}\n  {show(k)}: "
            mark = ","
            if k != "assignment":
                sha.update(show(body[k]).encode())
                yield show(body[k])
                continue
            inner = "{"
            for r in rows.orderBy("g").toLocalIterator():
                entry = f"{show(str(r['g']))}: {show(r['s'])}"
                sha.update(f"{'{' if inner == '{' else ', '}{entry}".encode())
                yield f"{inner}\n    {entry}"
                inner = ","
            sha.update(b"}" if inner == "," else b"{}")
            yield "\n  }" if inner == "," else "{}"
        sha.update(b"}")
        body["content_sha256"] = sha.hexdigest()
        yield f',\n  "content_sha256": {show(body["content_sha256"])}\n}}\n'

    if path:
        write_text(pieces(), path, groups.sparkSession)
    else:
        for _ in pieces():
            pass
    return body
