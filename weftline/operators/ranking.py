"""Ranks that never put one hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.bounded import small_side
from weftline.plans.durable import materialize


def salted_row_number(df: DataFrame, group: list[str], order: list[str | Column], out: str = "rank", buckets: int = 256, salt_on: list[str] | None = None) -> DataFrame:
    """Give every row a 0-based rank within ``group``, unique and without gaps.

    Rows of a group are spread over ``buckets`` hash buckets of ``salt_on`` (the
    ``group`` and order columns by default); ranks run bucket by bucket and, in a bucket,
    by ``order``. The order is therefore pseudo-random but reproducible. A group
    that holds a third of all rows is sorted in ``buckets`` pieces, and the
    offsets come from a pre-aggregated count table.

    NULL group values form a group of their own; an empty frame stays empty;
    equal ``order`` values get different ranks in undefined mutual order, so
    pass a unique order column where the result must be reproducible.
    """
    salt_on = salt_on or [c for c in order if isinstance(c, str)]
    g, b, n, off, at = (f"__{x}_{out}" for x in ("g", "b", "n", "off", "at"))
    rows = df.withColumn(b, F.pmod(F.xxhash64(*salt_on), F.lit(buckets)).cast("int"))
    rows = rows.withColumn(g, F.to_json(F.struct(*[F.col(c) for c in group]), {"ignoreNullFields": "false"})) if group else rows.withColumn(g, F.lit(""))
    counts = rows.groupBy(g, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(g).alias(g + "2"), F.col(b).alias(b + "2"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    ranked = rows.withColumn(at, F.row_number().over(Window.partitionBy(g, b).orderBy(*order)) - 1)
    joined = ranked.join(offsets, (F.col(g) == F.col(g + "2")) & (F.col(b) == F.col(b + "2")))
    return joined.withColumn(out, (F.col(off) + F.col(at)).cast("long")).drop(g, b, off, at, g + "2", b + "2")


def global_index(df: DataFrame, order: list[str], out: str = "index") -> DataFrame:
    """0-based position of every row in the order of ``order``, without a one-task sort.

    Rows are range-partitioned, written once, and numbered inside their range; the offsets of the
    ranges are a table of one row per range. NULLs come first. Rows with equal
    ``order`` values are told apart by a hash of the whole row, so they spread over ranges too; rows equal in all
    columns get positions in undefined mutual order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, at, off, tie = (f"__{x}_{out}" for x in ("part", "at", "off", "tie"))
    rows = df.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind]))
    rows = materialize(rows.repartitionByRange(n, *order, tie).withColumn(part, F.spark_partition_id()), "ranges")
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(F.col(part).alias(part + "2"), F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(off))
    numbered = rows.withColumn(at, F.row_number().over(Window.partitionBy(part).orderBy(*order, tie)) - 1)
    joined = numbered.join(F.broadcast(offsets), F.col(part) == F.col(part + "2"))  # one row per range
    return joined.withColumn(out, (F.col(off) + F.col(at)).cast("long")).drop(part, at, off, part + "2", tie)


def counted_values(df: DataFrame, value: str, group: list[str] | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """Distinct known values in order: ``group``, ``value``, ``n`` (rows), ``before`` (rows with smaller values, over the whole table), and further ``counts``.

    Only distinct values are range-partitioned and numbered, with their counts made map-side, so a value that most rows
    share is one row. NULL and NaN are left out. Written once.
    """
    group = group or []
    known = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.withColumn("__value", known).filter("__value is not null")
    per = rows.groupBy(*group, F.col("__value").alias("value")).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in (counts or {}).items()])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*group, "value"]
    ranges = materialize(per.repartitionByRange(parts, *order).withColumn("__i", F.spark_partition_id()), "values")
    ahead = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy(F.col("__i").alias("__r")).agg(F.sum("n").alias("__n")).select("__r", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__o"))  # one row per range
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("__i").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.withColumn("__in", inside).join(F.broadcast(offsets), F.col("__i") == F.col("__r"))
    return placed.withColumn("before", F.col("__o") + F.col("__in")).drop("__i", "__r", "__o", "__in")


def average_rank(df: DataFrame, value: str, out: str = "avg_rank") -> DataFrame:
    """1-based rank of ``value`` with ties at their mean, over the rows where it is known; NULL (and NaN) stay unranked.

    Ranks are those of the distinct values (``counted_values``), joined back.
    """
    v, r = f"__v_{out}", f"__r_{out}"
    known = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    ranked = counted_values(df.select(known.alias("v")), "v").select(F.col("value").alias(v), (F.col("before") + (F.col("n") + 1) / 2.0).alias(r))
    return df.join(ranked, known == F.col(v), "left").withColumn(out, F.col(r)).drop(v, r)


def percent_rank_average(df: DataFrame, value: str, out: str = "pct") -> DataFrame:
    """``average_rank`` divided by the number of known values."""
    n = df.agg(F.count(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")))).first()[0]
    return average_rank(df, value, out).withColumn(out, F.col(out) / F.lit(float(max(n, 1))))


def exact_quantiles(df: DataFrame, value: str, at: list[float], group: list[str] | None = None) -> DataFrame:
    """Exact quantiles by linear interpolation, as columns ``group``, ``q``, ``value``.

    Distinct values are ordered with their counts (``counted_values``); the two values beside each quantile
    are those whose rows hold its places, so no group is held in one task. NULL and NaN are
    skipped; a group without values has no rows. NULL is a group of its own.
    """
    group = group or []
    g = [f"__g{k}" for k in range(len(group))]
    values = counted_values(df.select(*[F.col(c).alias(x) for c, x in zip(group, g)], F.col(value).alias("__x")), "__x", g)
    size = values.groupBy(*g).agg(F.sum("n").alias("__n"), F.min("before").alias("__first"))
    place = F.col("q") * (F.col("__n") - 1)
    spots = size.filter("__n > 0").withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at]))).select(*[F.col(x).alias(f"{x}s") for x in g], "q", "__first", place.alias("place"))
    same = F.lit(True)
    for x in g:
        same = same & F.col(x).eqNullSafe(F.col(f"{x}s"))
    low, high = F.floor("place") + F.col("__first"), F.ceil("place") + F.col("__first")
    holds = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("n"))
    met = values.join(small_side(spots), same & (holds(low) | holds(high)))
    ends = met.groupBy(*g, "q").agg(F.min(F.when(holds(low), F.col("value"))).alias("lo"), F.max(F.when(holds(high), F.col("value"))).alias("hi"), F.max(F.col("place") - F.floor("place")).alias("w"))
    return ends.select(*[F.col(x).alias(c) for c, x in zip(group, g)], "q", (F.col("lo") + F.col("w") * (F.col("hi") - F.col("lo"))).alias("value"))
