"""Comparing runs: means, paired differences, bootstrap intervals, trends, rolling means."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.nulls import known
from weftline.operators.ranking import counted_values, exact_quantiles, global_index
from weftline.plans.durable import materialize


def common_keys(runs: list[DataFrame], key: str) -> DataFrame:
    """Keys that every run has."""
    if not runs:
        raise ValueError("no runs")
    out = runs[0].select(key).distinct()
    for r in runs[1:]:
        out = out.intersect(r.select(key))
    return out


def metric_means(df: DataFrame, metrics: list[str], group: list[str] | None = None) -> DataFrame:
    """Mean of the known values of each metric."""
    return df.groupBy(*(group or [])).agg(*[F.avg(known(m)).alias(m) for m in metrics])


def paired_compare(a: DataFrame, b: DataFrame, key: str, metric: str, group: list[str] | None = None) -> DataFrame:
    """Difference b - a over the keys where both are known: ``pairs``, ``mean_diff``, ``share_b_higher`` (NULL without pairs).

    ``group`` columns are taken from ``a``.
    """
    group = group or []
    left = a.select(key, *group, known(metric).alias("__a")).filter("__a is not null")
    right = b.select(F.col(key).alias("__k"), known(metric).alias("__b")).filter("__b is not null")
    d = left.join(right, F.col(key) == F.col("__k")).withColumn("__d", F.col("__b") - F.col("__a"))
    return d.groupBy(*group).agg(F.count(F.lit(1)).alias("pairs"), F.avg("__d").alias("mean_diff"), F.avg((F.col("__d") > 0).cast("double")).alias("share_b_higher"))


def signed_rank(a: DataFrame, b: DataFrame, key: str, metric: str, least: int = 10) -> DataFrame:
    """Wilcoxon's signed-rank test of b - a over common keys: ``n`` (differences that aren't 0), ``w_plus``, ``z``, ``p``.

    ``p`` is the two-sided normal approximation with correction for ties, NULL under ``least`` differences. Ranks are those of
    the distinct absolute differences with their counts, so nothing is sorted in one task and the runs are joined once.
    """
    left = a.select(key, known(metric).alias("__a")).filter("__a is not null")
    right = b.select(F.col(key).alias("__k"), known(metric).alias("__b")).filter("__b is not null")
    d = left.join(right, F.col(key) == F.col("__k")).select((F.col("__b") - F.col("__a")).alias("d")).filter("d <> 0").withColumn("m", F.abs("d"))
    t = counted_values(d, "m", counts={"up": F.count_if(F.col("d") > 0)})
    x = F.col("n").cast("double")
    rank = F.col("before") + (x + 1) / 2
    row = t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("up") * rank), F.lit(0.0)).alias("w"), F.coalesce(F.sum(x * x * x - x), F.lit(0.0)).alias("ties")).first()
    n, w, ties = row
    z = p = None
    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if n >= least and spread > 0:
        z = (w - n * (n + 1) / 4) / math.sqrt(spread)
        p = math.erfc(abs(z) / math.sqrt(2))
    return a.sparkSession.createDataFrame([(n, float(w), z, p)], "n long, w_plus double, z double, p double")


def _interval(key: str, value: str, n_boot: int, seed: int, level: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x = pdf.sort_values(key)[value].to_numpy(float)
        x = x[np.isfinite(x)]
        lo = hi = None
        if len(x) >= 2:
            rng = np.random.default_rng(seed)
            step = max(1, 5_000_000 // len(x))  # resamples in blocks; the generator's stream is the same
            means = np.concatenate([rng.choice(x, (min(step, n_boot - s), len(x))).mean(1) for s in range(0, n_boot, step)])
            lo, hi = (float(v) for v in np.quantile(means, [(1 - level) / 2, (1 + level) / 2]))
        mean = float(x.mean()) if len(x) else None
        return pd.DataFrame({"n": [len(x)], "mean": [mean], "ci_low": [lo], "ci_high": [hi]}).assign(**{c: pdf[c].iloc[0] for c in pdf.columns if c.startswith("g_")})

    return run


def bootstrap_interval(df: DataFrame, key: str, value: str, group: list[str], n_boot: int = 5000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Mean with a percentile bootstrap interval per group of evaluation results.

    Meant for metric tables (one row per test pair and run), which fit a task;
    values are ordered by ``key`` first, so a seed gives one result. Unknown values are dropped; fewer than two give no interval.
    """
    rows = df.select(key, known(value).alias(value), *[F.col(g).alias(f"g_{g}") for g in group])
    schema = "n long, mean double, ci_low double, ci_high double, " + ", ".join(f"g_{g} {df.schema[g].dataType.simpleString()}" for g in group)
    out = rows.groupBy(*[f"g_{g}" for g in group]).applyInPandas(_interval(key, value, n_boot, seed, level), schema)
    return out.select(*[F.col(f"g_{g}").alias(g) for g in group], "n", "mean", "ci_low", "ci_high")


def paired_report(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """One row for the difference b - a over common keys: ``pairs``, ``mean_diff``, ``ci_low``, ``ci_high``, ``share_b_higher``, ``significant`` (the interval leaves out 0) and the signed-rank ``p``.

    Measures are NULL without pairs, the interval with fewer than two.
    """
    means = paired_compare(a, b, key, metric)
    left = a.select(key, known(metric).alias("__a")).filter("__a is not null")
    right = b.select(F.col(key).alias("__k"), known(metric).alias("__b")).filter("__b is not null")
    d = left.join(right, F.col(key) == F.col("__k")).select(key, (F.col("__b") - F.col("__a")).alias("__d"), F.lit(0).alias("__g"))
    span, p = bootstrap_interval(d, key, "__d", ["__g"]).first(), signed_rank(a, b, key, metric).first()["p"]
    low, high = (span["ci_low"], span["ci_high"]) if span else (None, None)
    apart = F.lit(low is not None and (low > 0 or high < 0))
    return means.withColumns({"ci_low": F.lit(low).cast("double"), "ci_high": F.lit(high).cast("double"), "p": F.lit(p).cast("double"), "significant": apart})


def poisson_interval(df: DataFrame, key: str, value: str, group: list[str], n_boot: int = 400, level: float = 0.95) -> DataFrame:
    """Bootstrap interval for groups of any size: Poisson(1) weights by hash of (key, resample) instead of resampling by position.

    Each row adds to every resample's weighted sum map-side, so only ``n_boot`` sums per
    group are shuffled. ``ci_low`` and ``ci_high`` are exact quantiles of the resampled means.
    """
    # Cumulative probabilities of Poisson(1) for 0..6.
    cumulative = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]
    rows = df.select(*group, F.col(key).alias("__k"), known(value).alias("__v")).filter("__v is not null")
    rows = rows.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u = F.pmod(F.xxhash64("__k", "__b"), F.lit(1 << 30)) / float(1 << 30)
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cumulative), F.lit(0))
    means = rows.withColumn("__w", weight).groupBy(*group, "__b").agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("m")).filter("m is not null")
    q = exact_quantiles(means, "m", [(1 - level) / 2, (1 + level) / 2], group)
    return q.groupBy(*group).agg(F.min("value").alias("ci_low"), F.max("value").alias("ci_high"))


def run_trend(log: DataFrame, order: list[str], step: str, value: str) -> DataFrame:
    """Slope and change of a logged value: first tenth against last tenth of the rows, with the change's standard error.

    ``head``, ``tail``, ``change``, ``error`` (infinite when a tenth has fewer than two rows), ``slope_10k`` (0
    for two rows or fewer), ``significant`` if the change exceeds twice its error. Positions come from a range-partitioned order.
    """
    rows = log.select(*order, *([step] if step not in order else []), known(value).alias("__v")).filter("__v is not null")
    rows = materialize(global_index(rows, order, "__i"), "log")
    n = rows.count()
    k = max(1, n // 10)
    head, tail = F.when(F.col("__i") < k, F.col("__v")), F.when(F.col("__i") >= n - k, F.col("__v"))
    error = F.sqrt(F.var_samp(head) / k + F.var_samp(tail) / k) if k >= 2 else F.lit(float("inf"))
    slope = F.coalesce(F.regr_slope(F.col("__v"), F.col(step).cast("double")), F.lit(0.0)) * 10000 if n > 2 else F.lit(0.0)
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.avg(head).alias("head"), F.avg(tail).alias("tail"), error.alias("error"), slope.alias("slope_10k"))
    out = out.withColumn("change", F.col("tail") - F.col("head"))
    return out.withColumn("significant", F.coalesce(F.abs("change") > 2 * F.col("error"), F.lit(False)))


def rolling_mean(log: DataFrame, order: list[str], value: str, window: int = 40, block: int = 100_000, out: str = "rolling") -> DataFrame:
    """Mean of the last ``window`` rows (fewer at the start) in the order of ``order``.

    The order is range-partitioned; rows are cut into blocks, each of which also gets the ``window - 1`` rows
    before it, so the window function runs block by block in parallel. Unknown values are skipped in the means.
    """
    rows = global_index(log, order, "__i").withColumn("__b", F.floor(F.col("__i") / block))
    reach = F.when((F.col("__i") % block) >= block - (window - 1), F.array(F.col("__b"), F.col("__b") + 1)).otherwise(F.array("__b"))
    copies = rows.withColumn("__at", F.explode(reach))
    w = Window.partitionBy("__at").orderBy("__i").rowsBetween(-(window - 1), 0)
    return copies.withColumn(out, F.avg(known(value)).over(w)).filter("__at = __b").drop("__i", "__b", "__at")


def crosstab(df: DataFrame, rows: list[str], column: str, values: list) -> DataFrame:
    """Counts per ``rows`` and value of ``column``, 0 where there is none; the values are named, so no extra pass looks for them."""
    return df.groupBy(*rows).agg(*[F.sum(F.when(F.col(column) == v, 1).otherwise(0)).cast("long").alias(str(v)) for v in values])


def group_quantiles(df: DataFrame, group: str, value: str, at: list[float], digits: int = 1) -> DataFrame:
    """Rounded exact quantiles per group, one column per quantile (``p05`` for .05)."""
    q = exact_quantiles(df, value, at, [group])
    return q.groupBy(group).agg(*[F.round(F.max(F.when(F.col("q") == p, F.col("value"))), digits).alias(f"p{round(p * 100):02d}") for p in at])
