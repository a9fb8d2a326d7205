"""Consolidating pairwise matches: hash-to-min, and hooking with shortcutting.

Both label every vertex of an undirected match graph with the smallest vertex
it is linked to, directly or through others. They hold sets and parent arrays
as rows of tables, so no cluster is ever gathered into one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.plans.durable import materialize, materialize_marked, release


def _links(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("v"), F.col(dst).alias("u")).filter("v is not null and u is not null and v <> u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct()


def hash_to_min(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """Hash-to-min over a table of links; returns ``vertex``, ``group_id``.

    A row (v, u) says that u is in v's cluster set. In a round every v takes the
    minimum m of its set, sends its set to m (rows (m, u)) and sends m to
    each member (rows (u, m)), until the table no longer changes. Then each
    vertex other than a minimum holds only its group's minimum, and the minimum
    holds the group. The minimum is a map-side aggregate, and the set of a hot
    vertex is only ever split rows of a join (adaptive skew splitting), at most two
    rows for one before.

    NULL ends and self-links are ignored, repeated and reversed links count
    once, vertices without a link don't appear, and no links give no rows. Other
    columns of ``edges`` are not used. Order is by code point for strings.
    """
    link = _links(edges, src, dst)
    first = link.unionByName(link.select(F.col("u").alias("v"), F.col("v").alias("u")))
    start = first.unionByName(first.select("v", F.col("v").alias("u"))).distinct()
    cur, seen = materialize_marked(start, ["v", "u"], "h2m")
    for _ in range(max_rounds):  # two rounds per written table
        nxt, now = materialize_marked(_sent(_sent(cur)), ["v", "u"], "h2m")
        release(cur)
        cur = nxt
        if now == seen:
            return cur.groupBy(F.col("v").alias("vertex")).agg(F.min("u").alias("group_id"))
        seen = now
    raise RuntimeError(f"groups did not settle within {2 * max_rounds} rounds")


def _sent(sets: DataFrame) -> DataFrame:
    """What every vertex holds after one round."""
    low = sets.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "w")
    pair = lambda a, b: F.struct(F.col(a).alias("v"), F.col(b).alias("u"))
    sent = sets.join(low, F.col("v") == F.col("w")).select(F.explode(F.array(pair("m", "u"), pair("u", "m"))).alias("x"))
    return sent.select("x.v", "x.u").distinct()


def hook_and_shortcut(edges: DataFrame, src: str, dst: str, vertices: DataFrame | None = None, vertex: str | None = None, max_rounds: int = 60) -> DataFrame:
    """Components by hooking and shortcutting a parent table; returns ``vertex``, ``group_id``.

    The parent table starts with every vertex as its own parent. A round hooks:
    over every link between two trees, the larger root takes the smallest
    neighbouring root as parent (a pre-aggregated minimum); then it shortcuts:
    the parent of the parent becomes the parent, until all trees are stars. Links inside
    one tree drop out, so the link table shrinks each round. When no link is left
    every parent is the smallest vertex of its component: a root is only ever hooked
    onto a smaller one, and the smallest is never hooked.

    NULL ends, self-links and repeats are ignored; ``vertices`` adds vertices
    without links, each a group of its own. No rows in give no rows out.
    """
    link, (links, _) = materialize_marked(_links(edges, src, dst), ["v", "u"], "hook")
    ends = link.select(F.col("v").alias("vertex")).unionByName(link.select(F.col("u").alias("vertex")))
    if vertices is not None:
        ends = ends.unionByName(vertices.select(F.col(vertex or vertices.columns[0]).alias("vertex")).filter("vertex is not null"))
    parent = materialize(ends.distinct().select("vertex", F.col("vertex").alias("parent")), "parent")
    for _ in range(max_rounds):
        if not links:
            release(link)
            return parent.select("vertex", F.col("parent").alias("group_id"))
        # Links run between roots. Hook: each root takes the smallest root it is linked to, if smaller.
        tree = link.groupBy(F.col("v").alias("root")).agg(F.min("u").alias("up"))
        while True:  # Shortcut the hooked roots, two steps per written table (the first is made together with the hooks); each halves the depth of the trees.
            seen = Observation()
            step = materialize(_shortcut(_shortcut(tree)).observe(seen, F.count_if("moved").alias("n")).drop("moved"), "tree")
            release(tree)
            tree = step
            if not seen.get["n"]:
                break
        to = tree.select("root", "up")
        grown = materialize(parent.join(to, F.col("parent") == F.col("root"), "left").select("vertex", F.coalesce("up", "parent").alias("parent")), "parent")
        l1 = link.join(to, F.col("v") == F.col("root"), "left").select(F.coalesce("up", "v").alias("v"), "u")
        l2 = l1.join(to, F.col("u") == F.col("root"), "left").select("v", F.coalesce("up", "u").alias("u"))
        nxt, (links, _) = materialize_marked(_links(l2, "v", "u"), ["v", "u"], "hook")
        release(parent, link, tree)
        parent, link = grown, nxt
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _shortcut(tree: DataFrame) -> DataFrame:
    """The parent of the parent as parent, and whether it moved."""
    above = tree.select(F.col("root").alias("r2"), F.col("up").alias("up2"))
    return tree.join(above, F.col("up") == F.col("r2"), "left").select("root", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved"))
