"""A varied subset of given size by tournament-pivoted rank-revealing QR."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import salted_row_number
from weftline.plans.bounded import small_side
from weftline.plans.durable import materialize, release

#: Rows that a tournament chooses in one round, rounds aimed at, and rows that a node holds to begin with.
ROUND, ROUNDS, NODE = 256, 4, 4096
#: Squared length of a row's group part beside its item part of length 1.
GROUP_WEIGHT = 0.5
#: Pieces into which the records of one item and group are cut for ranking.
_PIECES = 256


def pivoted_rows(item: np.ndarray, room: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Rows that a row-pivoted, rank-revealing QR takes first: at most ``k``, each the farthest from the span of those before; ties to the first row.

    A row is the sum of a unit direction of its item and a direction of its room with squared length ``weight``; all
    directions are orthogonal. The factor is computed from inner products (pivoted Cholesky of the rows' Gram matrix gives the
    pivots and the R of the QR), so dimensions may be as many as there are items. Rows of an item not taken yet
    keep a residual of 1 or more, rows of a taken one fall below: there the rank is revealed and nothing more is taken.
    """
    left = 1.0 + weight
    factor = np.zeros((len(item), min(k, len(item))))
    out = []
    for s in range(factor.shape[1]):
        p = int(np.argmax(left > left.max() - 1e-9))
        if left[p] < 1 - 1e-6:
            break
        out.append(p)
        inner = (item == item[p]).astype(np.float64) + np.where(room == room[p], weight, 0.0)
        column = (inner - factor[:, :s] @ factor[p, :s]) / np.sqrt(left[p])
        factor[:, s] = column
        left = left - column * column
        left[p] = -1.0
    return np.array(out, np.int64)


def _best(t: pa.Table, k: int) -> pa.Table:
    """The ``k`` pivots of a node's rows; rows beyond ``NODE`` re-pivot with the pivots so far."""
    t = t.sort_by([("late", "ascending"), ("item", "ascending"), ("class", "ascending")])
    best = t.slice(0, 0)
    for s in range(0, t.num_rows, NODE):
        rows = pa.concat_tables([best, t.slice(s, NODE)])
        best = rows.take(pa.array(pivoted_rows(*[rows[c].to_numpy() for c in ("item", "room", "weight")], k)))
    return best


def _tournament(rows: DataFrame, k: int, nodes: int, cores: int) -> DataFrame:
    """The winners of every shard: nodes nominate, and nodes 2i and 2i + 1 of a level meet in node i of the next."""
    schema = "class long, item long, room long, weight double, late int, shard int, node int"
    place = "class long, item long, room long, place int"

    def last(t: pa.Table) -> pa.Table:
        won = _best(t, k)
        return won.select(["class", "item", "room"]).append_column("place", pa.array(np.arange(won.num_rows), pa.int32()))

    cur = rows
    while nodes > 1:
        cur = cur.repartition(cores, "shard", "node").groupBy("shard", "node").applyInArrow(lambda t: _best(t, k), schema)
        nodes = -(-nodes // 2)
        cur = cur.withColumn("node", F.floor(F.col("node") / 2).cast("int"))
    return cur.repartition(cores, "shard", "node").groupBy("shard", "node").applyInArrow(last, place)


def full_turns(counts: dict[int, int], k: int) -> int:
    """The most records that every item can give (all it has, if fewer) without exceeding ``k`` in all; ``counts``: records of an item -> items."""
    turns, given, items = 0, 0, sum(counts.values())
    for n in sorted(counts):
        more = min(n - turns, (k - given) // items)
        turns, given = turns + more, given + more * items
        if turns < n:
            return turns
        items -= counts[n]
        if not items:
            break
    return turns


def _quotas(classes: DataFrame, turns: int) -> DataFrame:
    """``classes`` with ``q``: how many of the item's first ``turns`` records each of its classes gives, as evenly as they can, those without a group last."""
    order = Window.partitionBy("item", "late").orderBy("n", "class")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("item", "late")
    rows = classes.withColumns({"__smaller": F.coalesce(F.sum("n").over(before), F.lit(0)), "__at": F.row_number().over(order) - 1, "__m": F.count(F.lit(1)).over(whole)})
    late = Window.partitionBy("item").orderBy("late").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__budget", F.greatest(F.lit(0), F.lit(turns) - F.coalesce(F.sum("n").over(late), F.lit(0))))
    left, share = F.col("__budget") - F.col("__smaller"), F.col("__m") - F.col("__at")
    # Smallest classes first: one that fits into an even share is taken whole, and what it leaves goes to the larger ones.
    rows = rows.withColumn("__whole", F.col("n") * share <= left)
    taken = F.sum(F.when(F.col("__whole"), F.col("n")).otherwise(0)).over(whole)
    fit = F.sum(F.col("__whole").cast("long")).over(whole)
    rows = rows.withColumns({"__rest": F.col("__budget") - taken, "__open": F.col("__m") - fit, "__fit": fit})
    even = F.floor(F.col("__rest") / F.greatest(F.col("__open"), F.lit(1))) + ((F.col("__at") - F.col("__fit")) < F.col("__rest") % F.greatest(F.col("__open"), F.lit(1))).cast("long")
    return rows.withColumn("q", F.when(F.col("__whole"), F.col("n")).otherwise(even)).drop("__smaller", "__at", "__m", "__budget", "__whole", "__rest", "__open", "__fit")


def _last_turn(classes: DataFrame, turns: int, k: int, items: int) -> list[DataFrame]:
    """Written tables with the ``class`` of ``k`` of the items that have more than ``turns`` records, one each, chosen by tournaments in deflated rounds.

    Items are dealt to shards, whose tournaments run side by side, so the number of rounds doesn't follow ``k``. After a round
    what was chosen is projected out: an item's row is gone, and of a room from which m rows
    were chosen the squared length w of the direction shrinks to w / (1 + m w), the part orthogonal to their span (m is
    taken per shard). Rooms with few choices so far are therefore the farthest from the span.
    """
    spark = classes.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = max(1, -(-k // (ROUND * ROUNDS)))
    nodes = max(1, -(-items // (shards * NODE)))
    shard, node = F.pmod("item", F.lit(shards)).cast("int"), F.pmod(F.xxhash64("class"), F.lit(nodes)).cast("int")
    able = classes.filter((F.col("total") > turns) & (F.col("n") > F.col("q"))).select("class", "item", "room", "late", shard.alias("shard"), node.alias("node"))
    able = materialize(able, "able")
    before = classes.groupBy(F.col("room").alias("r")).agg(F.sum("q").alias("m"))
    chosen, count = [], 0
    while count < k:
        m, open_ = before, able
        if chosen:
            all_ = _union(chosen)
            m = m.unionByName(all_.groupBy(F.col("room").alias("r")).agg(F.count(F.lit(1)).alias("m"))).groupBy("r").agg(F.sum("m").alias("m"))
            open_ = able.join(small_side(all_.select(F.col("item").alias("i"))), F.col("item") == F.col("i"), "left_anti")
        weight = GROUP_WEIGHT / (1 + GROUP_WEIGHT * F.coalesce("m", F.lit(0)) / shards)
        rows = open_.join(small_side(m), F.col("room") == F.col("r"), "left").select("class", "item", "room", weight.cast("double").alias("weight"), "late", "shard", "node")
        each = -(-min(k - count, shards * ROUND) // shards)
        won = materialize(_tournament(rows, each, nodes, min(cores, shards * nodes)), "won")
        n = won.count()
        if not n:
            break
        if count + n > k:  # the shards' last winners are too many: some of them go, by rank
            spare = won.filter(F.col("place") == each - 1)
            keep = k - count - (n - spare.count())
            kept = salted_row_number(spare, [], ["class"], "__rank").filter(F.col("__rank") < keep).drop("__rank")
            cut = materialize(won.filter(F.col("place") < each - 1).unionByName(kept), "won")
            release(won)
            won, n = cut, k - count
        chosen.append(won)
        count += n
    release(able)
    return chosen


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def varied_subset(df: DataFrame, k: int | None = None, key: str = "pair_id", item: str = "sku_id", group: str = "category_group", seed: int = 0, share: float | None = None, split: str | None = "train", split_column: str = "split") -> DataFrame:
    """``k`` distinct records (all, if there are fewer) over as many items and groups as possible: ``key``, ``item``, ``group`` (trimmed, lower case).

    ``share`` may give the size as a share of the distinct records instead. Only records of ``split`` are chosen from (labels are
    compared without case and outer blanks); None takes all.

    Every item gives as many records as all items can give (``full_turns``; mostly 0), evenly over its groups; who gives one more is decided
    by tournaments of rank-revealing QR on rows that stand for the record's item and group. Nodes nominate rows that lie farthest from the span of
    those before, pairwise reductions re-pivot the nominees, and the winners are projected out (deflated) before the next round: no item comes
    twice before all others, and a group is the less near the more was chosen from it, so a large group can't
    crowd out others and every group is present as soon as ``k`` allows.

    Records with the same item and group are one row, so tournaments run on their pre-aggregated counts, never on the records of a large item; the
    records behind a choice are the first by hash of the key, ranked in pieces. Repeated keys count once (smallest item and group),
    NULL keys are dropped, NULL items and groups are an item and a group of their own,
    but an item's records with a group come before those without. Choices are written tables; the driver holds only the numbers of items by their
    number of records (at most sqrt(2 * records)). Empty input or ``k`` of 0 gives no rows.
    """
    clean = F.nullif(F.lower(F.trim(F.col(group))), F.lit(""))
    rows = df if split is None else df.filter(F.lower(F.trim(F.col(split_column))) == split)
    src = rows.select(F.col(key).alias("key"), F.col(item).cast("string").alias("item_name"), clean.alias("group_name")).filter("key is not null")
    one = src.groupBy("key").agg(F.min(F.struct(F.col("item_name").isNull().alias("a"), "item_name", F.col("group_name").isNull().alias("b"), "group_name")).alias("m")).select("key", "m.item_name", "m.group_name")
    name = lambda c: F.coalesce(c, F.lit("\0"))
    hashed = one.withColumns({"class": F.xxhash64(F.lit(seed), name("item_name"), name("group_name")), "item": F.xxhash64(F.lit(seed), name("item_name")), "h": F.xxhash64(F.lit(seed), "key")})
    records = materialize(hashed, "records")
    classes = records.groupBy("class", "item", "group_name").agg(F.count(F.lit(1)).alias("n"))
    # An item's records without a group stand in its smallest group, after those that have one.
    of_item = classes.groupBy(F.col("item").alias("i")).agg(F.min("group_name").alias("home"), F.sum("n").alias("total"))
    classes = classes.join(of_item, F.col("item") == F.col("i")).select("class", "item", "n", "total", F.xxhash64(name(F.coalesce("group_name", "home"))).alias("room"), F.col("group_name").isNull().cast("int").alias("late"))
    classes = materialize(classes, "classes")
    counts = {r["total"]: r["items"] for r in classes.groupBy("total").agg(F.countDistinct("item").alias("items")).collect()}  # at most sqrt(2 * records) rows
    total = sum(n * items for n, items in counts.items())
    k = min(total, max(0, round(share * total) if k is None else k))
    turns = full_turns(counts, k) if k else 0
    quota = classes.withColumn("q", F.lit(0).cast("long"))
    if turns:
        quota = materialize(_quotas(classes, turns), "quotas")
    rest = k - sum(min(n, turns) * items for n, items in counts.items())
    taken = quota.filter("q > 0").select("class", "q")
    last = _last_turn(quota, turns, rest, sum(items for n, items in counts.items() if n > turns)) if rest else []
    if last:
        taken = taken.unionByName(_union(last).select("class", F.lit(1).cast("long").alias("q"))).groupBy("class").agg(F.sum("q").alias("q"))
    taken = materialize(taken, "taken")
    release(classes, quota, *last)
    most = taken.agg(F.max("q")).first()[0] or 0
    side = small_side(taken.select(F.col("class").alias("c"), "q"))
    mine = records.join(side, F.col("class") == F.col("c")).drop("c").withColumn("piece", F.pmod("h", F.lit(_PIECES)).cast("int"))
    sizes = mine.groupBy(F.col("class").alias("c"), F.col("piece").alias("p")).agg(F.count(F.lit(1)).alias("size"))
    offset = F.coalesce(F.sum("size").over(Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("c", "p", offset.alias("start"))
    # The rank filter is a constant, so each partition keeps its first rows before the shuffle.
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("class", "piece").orderBy("h", "key"))).filter(F.col("rank") <= int(most))
    out = ranked.join(starts, (F.col("class") == F.col("c")) & (F.col("piece") == F.col("p"))).filter(F.col("start") + F.col("rank") <= F.col("q"))
    return out.select(F.col("key").alias(key), F.col("item_name").alias(item), F.col("group_name").alias(group))
