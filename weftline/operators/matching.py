"""Similarity to reference vectors, rank statistics and thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.nulls import known
from weftline.operators.ranking import counted_values, exact_quantiles, percent_rank_average
from weftline.plans.bounded import small_side


def reference_bank(df: DataFrame, item: str, vector: str, is_reference: str) -> DataFrame:
    """Reference vectors of each item, one per row; NULL and empty vectors (nothing found) are left out."""
    return df.filter(F.expr(is_reference) & F.col(item).isNotNull() & (F.size(vector) > 0)).select(F.col(item).alias("bank_item"), F.col(vector).alias("bank_vector"))


def bank_sizes(bank: DataFrame) -> DataFrame:
    return bank.groupBy("bank_item").agg(F.count(F.lit(1)).alias("vectors"))


#: Vectors of one item that a task multiplies at a time.
BLOCK = 512


def _blocks(rows: DataFrame, item: str, vector: str, key: str | None, block: int) -> DataFrame:
    """Rows of ``item`` packed into blocks of about ``block`` vectors of one length: ``__item``, ``__dim``, ``vectors`` (and ``keys``)."""
    sized = rows.select(F.col(item).alias("__item"), F.size(vector).alias("__dim"), F.col(vector).alias("v"), *([F.col(key).alias("k")] if key else []))
    hot = sized.groupBy(F.col("__item").alias("i")).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).filter("blocks > 1")
    dealt = sized.join(small_side(hot), F.col("__item") == F.col("i"), "left")
    dealt = dealt.withColumn("__b", F.coalesce(F.pmod(F.xxhash64("k" if key else "v"), F.col("blocks")), F.lit(0)))
    lists = [F.collect_list("v").alias("vectors"), F.collect_list("k").alias("keys")] if key else [F.collect_set("v").alias("vectors")]
    # Shuffled by block, not by item: a hot item's blocks are made in different tasks.
    return dealt.repartition("__item", "__dim", "__b").groupBy("__item", "__dim", "__b").agg(*lists).drop("__b")


def _compared(measure: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], names: list[str]):
    """Per pair of blocks: the greatest of each ``measure`` of every query over the references; NULL where there is none."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                keys = b["keys"].slice(r, 1).flatten()
                q, refs = (np.array(b[c][r].as_py(), np.float64) for c in ("vectors", "refs"))
                best = [np.where(np.isnan(x), -np.inf, x) for x in measure(q, refs)]
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(x, mask=np.isneginf(x)) for x in best]], ["k", *names])

    return run


def _best_of_item(queries: DataFrame, bank: DataFrame, key: str, item: str, vector: str, measure, names: list[str], block: int) -> DataFrame:
    """``queries`` with the greatest of each measure over the references of their item, found block by block."""
    q = _blocks(queries.filter(F.size(vector) > 0).filter(F.col(item).isNotNull()), item, vector, key, block)
    refs = _blocks(bank, "bank_item", "bank_vector", None, block).select(F.col("__item").alias("__ri"), F.col("__dim").alias("__rd"), F.col("vectors").alias("refs"))
    met = q.join(refs, (F.col("__item") == F.col("__ri")) & (F.col("__dim") == F.col("__rd"))).select("keys", "vectors", "refs")
    schema = f"k {queries.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names)
    best = met.mapInArrow(_compared(measure, names), schema).groupBy(F.col("k").alias("__k")).agg(*[F.max(n).alias(n) for n in names])
    return queries.drop(*names).join(best, F.col(key) == F.col("__k"), "left").drop("__k")


def max_similarity(queries: DataFrame, bank: DataFrame, key: str, item: str, vector: str, out: str = "garment_sim", block: int = BLOCK) -> DataFrame:
    """Greatest inner product of each query with the references of its own item; NULL without vector or reference.

    Queries and references of an item are packed into blocks of about ``block`` vectors; blocks of one item and vector length meet
    and are multiplied as matrices, so a hot item is many pairs of blocks over many tasks, and the maximum per query
    is taken over its blocks. Equal references count once.
    """
    return _best_of_item(queries, bank, key, item, vector, lambda q, refs: [np.where(np.isnan(x := q @ refs.T), -np.inf, x).max(1)], [out], block)


def _colours(q: np.ndarray, refs: np.ndarray) -> list[np.ndarray]:
    away = np.sqrt(((q[:, None, :3] - refs[None, :, :3]) ** 2).sum(2)).min(1)
    common = np.array([np.minimum(x[3:], refs[:, 3:]).sum(1).max() for x in q])
    return [-away, common]


def colour_likeness(queries: DataFrame, bank: DataFrame, key: str, item: str, vector: str, block: int = 128) -> DataFrame:
    """How like in colour each query is to the references of its item: ``colour_med`` (minus the least distance of median colours) and ``colour_hist`` (the greatest
    overlap of histograms); vectors are three median components and a histogram. Blocks and NULLs as in ``max_similarity``.
    """
    return _best_of_item(queries, bank, key, item, vector, _colours, ["colour_med", "colour_hist"], block)


def colour_rank(df: DataFrame, first: str, second: str, out: str = "colour_rank", nulls: str = "lowest") -> DataFrame:
    """Sum of the percentile ranks of two signals.

    ``nulls="lowest"``: unknown values rank below all others and all rows count.
    ``nulls="skip"``: only known values are ranked, and an unknown one adds 0.
    """
    if nulls not in ("lowest", "skip"):
        raise ValueError(f"unknown null policy {nulls!r}")
    filled = {c: F.coalesce(known(c), F.lit(-1e9)) if nulls == "lowest" else known(c) for c in (first, second)}
    d = df.withColumn("__a", filled[first]).withColumn("__b", filled[second])
    d = percent_rank_average(percent_rank_average(d, "__a", "__pa"), "__b", "__pb")
    return d.withColumn(out, F.coalesce("__pa", F.lit(0.0)) + F.coalesce("__pb", F.lit(0.0))).drop("__a", "__b", "__pa", "__pb")


def quantile(df: DataFrame, value: str, q: float) -> float | None:
    """One exact quantile of the known values; None without any."""
    r = exact_quantiles(df, value, [q]).first()
    return None if r is None else r["value"]


def auc(df: DataFrame, positive: str, score: str, group: list[str] | None = None) -> DataFrame:
    """Rank AUC of the known scores: ``auc``, ``n_pos``, ``n_neg``; NULL if a class is empty. Rows with unknown score or class are left out."""
    if group:
        raise ValueError("compute groups one by one: ranks are global")
    rows = df.select(F.col(positive).cast("boolean").alias("__p"), known(score).alias("__s")).filter("__p is not null and __s is not null")
    values = counted_values(rows, "__s", counts={"pos": F.sum(F.col("__p").cast("long"))})
    rank = F.col("before") + (F.col("n") + 1) / 2.0
    a = values.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum(F.col("n") - F.col("pos")), F.lit(0)).alias("n_neg"), F.sum(F.col("pos") * rank).alias("__up"))
    value = (F.col("__up") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return a.select(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), value).alias("auc"), "n_pos", "n_neg")


def _quality(tp, fp, fn):
    return [F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall")]


def threshold_sweep(df: DataFrame, positive: str, score: str, steps: int = 40, last: float = 0.9) -> DataFrame:
    """Precision and recall of ``score >= threshold`` at ``steps`` quantiles from 0 to ``last``; thresholds without a true positive are left out.

    The thresholds are exact quantiles; one pass counts each row under all thresholds it passes
    (a row is placed among the sorted thresholds once, then counts are summed up).
    """
    rows = df.select(F.col(positive).cast("boolean").alias("p"), known(score).alias("s")).filter("p is not null and s is not null")
    at = [last * i / (steps - 1) for i in range(steps)]
    t = {r["q"]: r["value"] for r in exact_quantiles(rows, "s", at).collect()}
    points = [(i, t[q]) for i, q in enumerate(at) if q in t]
    values = sorted(v for _, v in points)
    place = F.aggregate(F.array(*[F.lit(v) for v in values]), F.lit(0), lambda n, v: n + F.when(F.col("s") >= v, 1).otherwise(0)) if values else F.lit(0)
    by = rows.groupBy(place.alias("n")).agg(F.sum(F.col("p").cast("long")).alias("pos"), F.count(F.lit(1)).alias("all")).collect()  # at most steps + 1 rows
    total, out = sum(r["pos"] for r in by), []
    for i, v in points:
        need = sum(v >= x for x in values)
        tp, kept = (sum(r[c] for r in by if r["n"] >= need) for c in ("pos", "all"))
        if tp:
            out.append((i, float(v), kept, tp / kept, tp / total))
    return df.sparkSession.createDataFrame(out, "step int, threshold double, kept long, precision double, recall double")


def filter_quality(marked: DataFrame, positive: str, score: str, threshold: float | None = None, quantile_of: DataFrame | None = None, q: float = 0.45) -> DataFrame:
    """tp, fp, fn, precision and recall of ``score >= threshold`` on rows with known class and score.

    Without ``threshold`` it is the exact ``q`` quantile of the scores of ``quantile_of`` (the table that is filtered; ``marked`` by default).
    """
    if threshold is None:
        threshold = quantile(marked if quantile_of is None else quantile_of, score, q)
    rows = marked.select(F.col(positive).cast("boolean").alias("p"), (known(score) >= F.lit(threshold).cast("double")).alias("k")).filter("p is not null and k is not null")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("long")
    a = rows.agg(n(F.col("k") & F.col("p")).alias("tp"), n(F.col("k") & ~F.col("p")).alias("fp"), n(~F.col("k") & F.col("p")).alias("fn"))
    return a.select("tp", "fp", "fn", *_quality(F.col("tp"), F.col("fp"), F.col("fn")))
