"""Splits that keep linked records together, with totals as near the given shares as group sizes allow."""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import hook_and_shortcut
from weftline.llm.designs import design_spelling, same_links
from weftline.operators.ranking import salted_row_number
from weftline.plans.bounded import small_side
from weftline.plans.durable import materialize

def closest_subset(sizes: Mapping[int, int], target: int) -> dict[int, int]:
    """How many groups of each size to take so that their total is as near ``target`` as possible.

    ``sizes``: size -> number of groups. Reachable totals are the bits of one integer; a
    size with multiplicity c joins it as 1, 2, 4, ... copies, so the work is at most
    (distinct sizes * log multiplicity) shifts, and ends as soon as the multiple of that divisor nearest to the target is reached. Beside the bits, an array names the
    step that first reached each total, so memory is in proportion to the target divided by the sizes' greatest common divisor. The
    same optimum at every size; the lower of two equally near totals wins. Empty sizes or a target of 0 take nothing.
    """
    left = {s: c for s, c in sizes.items() if s > 0 and c > 0}
    if target <= 0 or not left:
        return {}
    unit = math.gcd(*left)
    low = target // unit
    # The nearest total exceeds the target by at most half a group (else it is nearer without it) and at most the target (nothing is as near).
    limit = low + 1 + min(max(left) // unit // 2 + 1, low)
    goal = low if target - low * unit <= (low + 1) * unit - target else low + 1
    items = []
    for s in sorted(left, reverse=True):
        c, k = left[s], 1
        while c > 0:
            items.append((s, min(k, c)))
            c, k = c - min(k, c), k * 2
    bits, mask = 1, (1 << (limit + 1)) - 1
    by = np.zeros(limit + 1, np.min_scalar_type(len(items)))  # total -> number of the step that first reached it
    for step, (s, k) in enumerate(items, 1):
        new = (bits << (s // unit * k)) & mask & ~bits
        bits |= new
        _mark(by, new, step)
        if bits >> goal & 1:
            break
    under = (bits & ((1 << (low + 1)) - 1)).bit_length() - 1
    above = bits >> (low + 1)
    over = low + 1 + ((above & -above).bit_length() - 1) if above else None
    total = under if over is None or target - under * unit <= over * unit - target else over
    taken: dict[int, int] = {}
    while total:
        s, k = items[int(by[total]) - 1]
        taken[s] = taken.get(s, 0) + k
        total -= s // unit * k
    return taken


def _mark(by: np.ndarray, bits: int, step: int, piece: int = 1 << 20) -> None:
    """Set ``by`` to ``step`` at the places of the set ``bits``, a piece of bytes at a time."""
    raw = np.frombuffer(bits.to_bytes(len(by) // 8 + 1, "little"), np.uint8)
    for start in range(0, len(raw), piece):
        part = raw[start : start + piece]
        if part.any():
            at = np.flatnonzero(np.unpackbits(part, bitorder="little")) + 8 * start
            by[at] = step


def closest_splits(sizes: Mapping[int, int], targets: Mapping[str, int]) -> list[tuple[str, dict[int, int]]]:
    """Groups of each size for every split, in the order in which splits are solved.

    Each split is solved on what those before leave; all orders of the splits are tried (up to 4 splits), and the
    one with the least total distance from the targets wins, the first of equal ones.
    """
    names = list(targets)
    best, least = [], None
    for order in permutations(names) if len(names) <= 4 else [names]:
        left, plan, off = dict(sizes), [], 0
        for name in order:
            take = closest_subset(left, targets[name])
            for s, k in take.items():
                left[s] -= k
            plan.append((name, take))
            off += abs(sum(s * k for s, k in take.items()) - targets[name])
        if least is None or off < least:
            best, least = plan, off
        if not off:
            break
    return best


def item_groups(items: DataFrame, links: DataFrame, item: str = "sku_id", design: str = "design_id") -> DataFrame:
    """``item``, ``group_id``, ``given``: each item once with the component of its design and its delivered split.

    A design without links is a group named by itself. An item without a design is a group named by the item.
    An item in rows with several designs counts with the smallest.
    """
    one = items.select(F.col(item).alias("item"), design_spelling(design).alias("design"), F.lower(F.trim("split")).alias("given")).filter("item is not null")
    one = materialize(one.groupBy("item").agg(F.min("design").alias("design"), F.min("given").alias("given"), F.max("given").alias("given_too")), "items")
    parts = hook_and_shortcut(same_links(links), "a", "b", vertices=one.select("design"), vertex="design")
    return one.join(parts, F.col("design") == F.col("vertex"), "left").select("item", F.coalesce("group_id", "item").alias("group_id"), "given", "given_too")


def assign_splits(items: DataFrame, links: DataFrame, shares: Mapping[str, float] | None = None, item: str = "sku_id", design: str = "design_id") -> DataFrame:
    """``sku_id``, ``group_id``, ``split``: every item once, all items of a group in one split.

    ``shares`` gives each split its share of the items; the first split takes what the others
    leave (default train .7, val .15, test .15). Which sizes go to which
    split is solved on the histogram of group sizes (at most sqrt(2 * items)
    rows); groups of one size are told apart by a salted rank, so even
    millions of single-item groups are never sorted in one task. The driver's memory follows the largest target: a bit and
    a small number per total. A group larger than a split's share stays in the first split. Empty tables give no rows.
    """
    shares = dict(shares or {"train": 0.7, "val": 0.15, "test": 0.15})
    rest, *others = shares
    members = materialize(item_groups(items, links, item, design), "members")
    groups = materialize(members.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")), "groups")
    left = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(s * c for s, c in left.items())
    bounds, at = [], dict.fromkeys(left, 0)
    for name, take in closest_splits(left, {n: round(shares[n] * total) for n in others}):
        for s, k in take.items():
            bounds.append((s, at[s], at[s] + k, name))
            at[s] += k
    ranked = salted_row_number(groups, ["size"], ["group_id"], "at")
    table = groups.sparkSession.createDataFrame(bounds, "bsize long, lo long, hi long, chosen string")
    placed = ranked.join(small_side(table), (F.col("size") == F.col("bsize")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")), "left")
    placed = placed.select(F.col("group_id").alias("g"), F.coalesce("chosen", F.lit(rest)).alias("split"))
    return members.join(placed, F.col("group_id") == F.col("g")).select(F.col("item").alias(item), "group_id", "split")


def broken_groups(items: DataFrame, links: DataFrame, item: str = "sku_id", design: str = "design_id") -> DataFrame:
    """``group_id`` of the groups whose items carry more than one delivered split (compared without case and outer blanks; NULL doesn't count)."""
    members = item_groups(items, links, item, design)
    seen = members.groupBy("group_id").agg(F.min("given").alias("lo"), F.max("given_too").alias("hi"))
    return seen.filter("lo <> hi").select("group_id")
