"""Pipelines over stored tables: each reads tables, composes operators and replaces its results."""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import Roots
from weftline.functions import images, pixels
from weftline.functions.ids import base_title, blake_shard, design_key, variant_number
from weftline.operators import catalog, copies, frames, labeling, matching, pairs, runners, splits, stages, stats
from weftline.operators.assets import count_variants, health, inventory
from weftline.plans.bounded import small_side
from weftline.plans.durable import exists, has_files, materialize, release
from weftline.sources import directory
from weftline.sources.readers import LABELS, read_labels, read_log, read_metrics, read_table
from weftline.sources.writers import read_stage, replace_stage_rows, replace_table, write_bytes, write_json, write_metrics, write_stage, write_text


def build_manifest(spark: SparkSession, roots: Roots, config: Mapping) -> dict[str, DataFrame]:
    """Item and frame tables of the raw lake; returns reports."""
    raw, layout = roots.need("raw"), config["layout"]
    branches = {layout["product_dir"]: "product", layout["review_dir"]: "review"}
    found = directory.scan_frames(spark, raw, branches)
    info = catalog.merge_pairs(directory.read_info(spark, raw, layout["info_file"]), "rel_dir", "key", "value", "pos")
    attrs = catalog.as_map(info, "rel_dir", "key", "value").withColumnRenamed("rel_dir", "__d")
    typed = {k: config.get("info_names", {}).get(k, k) for k in config.get("info_columns", [])}
    per = found.groupBy(F.col("sku_id").alias("__s")).agg(*[F.sum((F.col("branch") == b).cast("int")).alias(f"n_{b}") for b in ("product", "review")])
    items = directory.scan_items(spark, raw, layout["info_file"]).join(attrs, F.col("rel_dir") == F.col("__d"), "left").join(per, F.col("sku_id") == F.col("__s"), "left")
    items = items.withColumn("title_base", base_title("folder")).withColumn("variant_no", variant_number("folder")).withColumn("design_id", design_key("folder", exact=True))
    items = items.withColumn("category_group", catalog.category_group("category_raw", config["categories"]))
    items = items.select("sku_id", "rel_dir", "folder", "title_base", "variant_no", "design_id", "category_raw", "category_group", *[F.coalesce(f"n_{b}", F.lit(0)).alias(f"n_{b}") for b in ("product", "review")], *catalog.pivot_keys("attrs", typed), catalog.residual_json("attrs", list(typed)).alias("attrs_json"))
    replace_table(count_variants(items), roots.table("manifest_sku.parquet"))
    replace_table(found.withColumn("aspect", F.when(F.col("height") > 0, F.col("width") / F.col("height"))), roots.table("manifest_images.parquet"))
    i, f = read_table(spark, roots.table("manifest_sku.parquet")), read_table(spark, roots.table("manifest_images.parquet"))
    return {"groups": inventory(i, f), "health": health(f, {"corrupt": "corrupt"}), "unmapped": i.filter("category_group = 'unmapped'").select("category_raw").distinct()}


def _files(spark: SparkSession, roots: Roots) -> DataFrame:
    """``__r`` (path below the raw root), ``content`` of the lake's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots.need("raw"))
    return files.select(directory.nfc(directory._relative("path", roots.need("raw"))).alias("__r"), "content")


def run_qc(spark: SparkSession, roots: Roots, limit: int | None = None) -> DataFrame:
    """Quality features beside the frames; returns sharpness quantiles per branch. ``limit`` tries some frames and replaces nothing.

    Features are computed where the files are read, and only they are shuffled to the frames, never the bytes. Frames without a file count as unread.
    """
    path = roots.table("manifest_images.parquet")
    images = read_table(spark, path)
    some = images if limit is None else images.orderBy("image_id").limit(limit)
    files = _files(spark, roots)
    if limit is not None:
        files = files.join(F.broadcast(some.select(F.col("rel_path").alias("__p"))), F.col("__r") == F.col("__p"), "left_semi")
    features = frames.frame_features(files, "__r")
    joined = some.select("image_id", "rel_path").join(features, F.col("rel_path") == F.col("__r"), "left").drop("rel_path", "__r")
    done = stages.join_features(some, materialize(joined.withColumn("read_ok", F.coalesce("read_ok", F.lit(False))), "qc"))
    if limit is None:
        replace_table(done, path)
        done = read_table(spark, path)
    return stats.group_quantiles(done, "branch", "sharpness", [0.05, 0.1, 0.5, 0.9])


def make_splits(spark: SparkSession, roots: Roots, seed: int = 20260906) -> tuple[dict[str, DataFrame], int]:
    """Annotated frames, design groups and splits, written as new columns; returns reports and the number of leaking contents.

    Unreadable frames stay in the table without a split. The check runs over all product frames that are no templates.
    """
    item_path, image_path = roots.table("manifest_sku.parquet"), roots.table("manifest_images.parquet")
    items = read_table(spark, item_path).drop("split_group", "split")
    images = read_table(spark, image_path).drop("dup_designs", "is_template", "label_ok", "is_canonical", "split_group", "split")
    facts = items.select(F.col("sku_id").alias("__s"), "design_id", "category_raw")
    noted = materialize(copies.annotate_copies(images.filter("read_ok").join(facts, F.col("sku_id") == F.col("__s")).drop("__s")), "noted")
    groups = materialize(copies.linked_designs(noted), "groups").withColumnRenamed("design_id", "__g")
    grouped = items.join(groups, F.col("design_id") == F.col("__g"), "left").drop("__g")
    assigned = materialize(splits.stratified_splits(splits.group_mode(grouped), seed=seed), "assigned")
    placed = assigned.select(F.col("split_group").alias("__p"), "split")
    full = materialize(grouped.join(placed, F.col("split_group") == F.col("__p"), "left").drop("__p"), "items")
    marks = noted.select(F.col("image_id").alias("__i"), "dup_designs", "is_template", "label_ok", "is_canonical")
    place = full.select(F.col("sku_id").alias("__s"), "split_group", "split")
    out = images.join(marks, F.col("image_id") == F.col("__i"), "left").join(place, F.col("sku_id") == F.col("__s"), "left").drop("__i", "__s")
    out = out.withColumns({c: F.when(F.col("read_ok"), F.col(c)) for c in ("split_group", "split")})
    replace_table(out, image_path)
    replace_table(full, item_path)
    done = read_table(spark, image_path)
    leak = splits.leak_check(done.filter("branch = 'product' and not is_template"))
    splits.certified_json(assigned, f"{roots.need('cache')}/splits.json", seed=seed, ratios=splits.SHARES)
    names = list(splits.SHARES)
    return {"by_group": stats.crosstab(full, ["category_group"], "split", names), "leak": leak}, leak.first()["contents_in_several_splits"]


def _stage(spark: SparkSession, roots: Roots, name: str) -> DataFrame:
    return read_stage(spark, roots.stage(name), "string", stages.STAGES[name].schema.split(" ", 1)[1])


def _working_set(spark: SparkSession, roots: Roots) -> DataFrame:
    return stages.working_set(read_table(spark, roots.table("manifest_images.parquet")), read_table(spark, roots.table("manifest_sku.parquet")))


def collect_signals(spark: SparkSession, roots: Roots) -> DataFrame:
    """The working set with the signals of the detect and pose stages; NULL where a stage hasn't run."""
    detect = _stage(spark, roots, "detect").select("image_id", F.from_json("payload", "n_persons double, area_frac double, max_area_frac double").alias("p"))
    detect = detect.select("image_id", "p.n_persons", F.coalesce("p.max_area_frac", "p.area_frac").alias("area_frac"))
    pose = _stage(spark, roots, "pose").select("image_id", F.from_json("payload", "scores map<string,double>").alias("p")).select("image_id", "p.*")
    replace_table(stages.collect_signals(_working_set(spark, roots), detect, pose), roots.table("signals.parquet"))
    return read_table(spark, roots.table("signals.parquet"))


def stage_work(spark: SparkSession, roots: Roots, stage: str, shard: int = 0, shards: int = 1, overwrite: bool = False, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the working set, rows that a stage would compute now). Shards are those of stored outputs.

    A stage folder inside a repository is refused: its files would be taken for sources.
    """
    if exists(spark, f"{roots.need('stages')}/.git"):
        raise ValueError("the stages root is a repository")
    rows = _working_set(spark, roots)
    todo = rows.filter(blake_shard("image_id", shards) == shard) if shards > 1 else rows
    todo = stages.pending_rows(todo, _stage(spark, roots, stage).select("image_id"), overwrite=overwrite)
    return rows, todo if limit is None else todo.orderBy("image_id").limit(limit)


#: Pending rows of a shard (id, path and group of each) that are sent to every worker at most.
PENDING_SENT = 1_000_000


def run_one_stage(spark: SparkSession, roots: Roots, stage: str, function, shard: int = 0, shards: int = 1, overwrite: bool = False, limit: int | None = None, batch: int = 64, content: bool = False) -> DataFrame:
    """Compute a stage for the pending rows of a shard; returns the rows that lack an input.

    New rows are added to the stage; with ``overwrite`` all rows of the shard are computed and take the place of what the stage had
    of them (rows that lack an input keep theirs). With ``content`` the function gets the frames' file bytes too: they are read where the files are, and
    kept only for pending rows, whose ids and paths are sent along (measured, up to ``PENDING_SENT`` rows; a shard with more joins the bytes by a shuffle, so use more shards).
    """
    _, todo = stage_work(spark, roots, stage, shard, shards, overwrite, limit)
    todo = materialize(todo, "todo")
    inputs = {n: _stage(spark, roots, n) for n in stages.STAGES[stage].needs}
    rows = todo
    if content:
        few = small_side(todo.select("image_id", "rel_path", "category_group"), PENDING_SENT)
        rows = _files(spark, roots).join(few, F.col("__r") == F.col("rel_path")).drop("__r")
    done = materialize(stages.run_stage(rows, stage, inputs, function, batch=batch), "stage")
    if overwrite:
        replace_stage_rows(done, done.select("image_id"), roots.stage(stage))
    else:
        write_stage(done, roots.stage(stage))
    release(done)
    return stages.missing_inputs(todo, stage, inputs)


def preprocess(spark: SparkSession, roots: Roots, stage: str, model=None, dry_run: bool = False, **kw) -> dict:
    """A stage with its own runner: ``rows`` of the working set, ``todo`` of them now, and ``missing`` (rows that lack each input).

    ``model`` is what the stage's runner calls (see ``operators.runners``); stages that need none are agnostic, agnostic_refined and colour.
    Keywords are those of ``run_one_stage``, and ``grow_px`` for the agnostic stage. A dry run only counts.
    """
    make, content, wants_model = runners.RUNNERS[stage]
    grow_px = kw.pop("grow_px", None)
    rows, todo = stage_work(spark, roots, stage, *[kw.get(k, v) for k, v in (("shard", 0), ("shards", 1), ("overwrite", False), ("limit", None))])
    out = {"rows": rows.count(), "todo": todo.count(), "missing": {}}
    if dry_run or not out["todo"]:
        return out
    if wants_model and model is None:
        raise ValueError(f"stage {stage} needs a model")
    runner = make(*([model] if wants_model else []), **({"grow_px": grow_px} if grow_px is not None and stage == "agnostic" else {}))
    missing = run_one_stage(spark, roots, stage, runner, content=content, **kw)
    out["missing"] = {r["missing"]: r["count"] for r in missing.groupBy("missing").count().collect()}
    return out


def similarity(spark: SparkSession, roots: Roots, labels: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Greatest similarity of each review frame to the worn references of its item, as a table; with a label file also AUC and threshold sweep of good against colour_mismatch."""
    signals = read_table(spark, roots.table("signals.parquet"))
    vectors = _stage(spark, roots, "embed").select(F.col("image_id").alias("__v"), "payload")
    with_v = signals.join(vectors, F.col("image_id") == F.col("__v"), "left").drop("__v")
    bank = matching.reference_bank(with_v, "sku_id", "payload", "branch = 'product' and n_persons > 0")
    out = matching.max_similarity(with_v.filter("branch = 'review'"), bank, "image_id", "sku_id", "payload")
    replace_table(out.select("image_id", "sku_id", "category_group", "garment_sim"), roots.table("garment_sim.parquet"))
    done = read_table(spark, roots.table("garment_sim.parquet"))
    if labels is None:
        return done, {}
    marked = materialize(_marked(done, read_labels(spark, labels), "good", "colour_mismatch", "color_mismatch"), "marked")
    return done, {"auc": matching.auc(marked, "positive", "garment_sim"), "sweep": matching.threshold_sweep(marked, "positive", "garment_sim")}


def _marked(rows: DataFrame, labels: DataFrame, good: str, *bad: str) -> DataFrame:
    """Rows with a label of the two classes, and ``positive``."""
    known = labels.filter(F.col("label").isin(good, *bad)).select(F.col("image_id").alias("__l"), (F.col("label") == good).alias("positive"))
    return rows.join(known, F.col("image_id") == F.col("__l")).drop("__l")


def colour_similarity(spark: SparkSession, roots: Roots) -> DataFrame:
    """``image_id``, ``colour_med``, ``colour_hist`` of each review frame against its item's worn product frames, as a table; higher means more alike.

    The pairs read this table; no other stage of the pipeline writes it. Frames without colour features have NULLs.
    """
    signals = read_table(spark, roots.table("signals.parquet"))
    vectors = _stage(spark, roots, "colour").select(F.col("image_id").alias("__v"), "payload")
    with_v = signals.join(vectors, F.col("image_id") == F.col("__v"), "left").drop("__v")
    bank = matching.reference_bank(with_v, "sku_id", "payload", "branch = 'product' and n_persons > 0")
    out = matching.colour_likeness(with_v.filter("branch = 'review'"), bank, "image_id", "sku_id", "payload").select("image_id", "colour_med", "colour_hist")
    replace_table(out, roots.table("colour_sim.parquet"))
    return read_table(spark, roots.table("colour_sim.parquet"))


def build_pairs(spark: SparkSession, roots: Roots, drop: float = pairs.COLOUR_DROP, min_white: float = pairs.MIN_WHITE) -> dict[str, DataFrame]:
    """The pair table out of signals, similarities and colour similarities (``image_id, colour_med, colour_hist``)."""
    signals = read_table(spark, roots.table("signals.parquet"))
    colour = matching.colour_rank(read_table(spark, roots.table("colour_sim.parquet")), "colour_med", "colour_hist").select(F.col("image_id").alias("__c"), "colour_rank")
    sim = read_table(spark, roots.table("garment_sim.parquet")).select(F.col("image_id").alias("__g"), "garment_sim")
    items = read_table(spark, roots.table("manifest_sku.parquet")).select(F.col("sku_id").alias("__s"), "design_id")
    f = signals.join(colour, F.col("image_id") == F.col("__c"), "left").join(sim, F.col("image_id") == F.col("__g"), "left").join(items, F.col("sku_id") == F.col("__s")).drop("__c", "__g", "__s")
    f = materialize(f, "frames")
    funnel = materialize(pairs.cascade_funnel(f, drop), "funnel")
    replace_table(pairs.build_pairs(f, drop, min_white), roots.table("manifest_pairs.parquet"))
    done = read_table(spark, roots.table("manifest_pairs.parquet"))
    return {"funnel": funnel, "pairs": stats.crosstab(done, ["arm", "category_group"], "split", list(splits.SHARES))}


def build_test_set(spark: SparkSession, roots: Roots, drop: float = pairs.COLOUR_DROP) -> tuple[dict[str, DataFrame], int]:
    """Confirmed test pairs; returns reports and the number of items that training has too.

    ``colour_auc`` and ``colour_filter`` say how well the colour filter (rank at or above the ``drop`` quantile of all frames) tells confirmed frames
    from those labelled wrong_colour; these labels had no part in setting it. They are there if colour similarities are.
    """
    labels = read_labels(spark, f"{roots.need('cache')}/labeling/labels_verify*.csv")
    signals, table = read_table(spark, roots.table("signals.parquet")), read_table(spark, roots.table("manifest_pairs.parquet"))
    replace_table(pairs.test_set(signals, labels, table), roots.table("test_set.parquet"))
    tests = read_table(spark, roots.table("test_set.parquet"))
    reports = {"summary": pairs.test_set_summary(tests)}
    if exists(spark, roots.table("colour_sim.parquet")):
        ranked = materialize(matching.colour_rank(read_table(spark, roots.table("colour_sim.parquet")), "colour_med", "colour_hist", nulls="skip"), "colour")
        marked = materialize(_marked(ranked, labels, "ok", "wrong_colour"), "marked")
        reports["colour_auc"] = matching.auc(marked, "positive", "colour_rank")
        reports["colour_filter"] = matching.filter_quality(marked, "positive", "colour_rank", quantile_of=ranked, q=drop)
    return reports, splits.overlap(tests, table.filter("split <> 'test'"), "sku_id").count()


# Metric -> whether higher (1) or lower (-1) is better.
DIRECTIONS = {"lpips_mask": -1, "l1_mask": -1, "lpips": -1, "ssim": 1}


def _run_metrics(spark: SparkSession, runs: Mapping[str, str], reference: str | None, metrics) -> tuple[str, DataFrame, DataFrame, dict[str, int]]:
    """(reference, cells of the common pairs, differences from the reference, pairs of each run that others lack)."""
    if not runs:
        raise ValueError("no runs")
    reference = reference or next(iter(runs))
    if reference not in runs:
        raise ValueError(f"reference {reference!r} is none of {sorted(runs)}")
    tables = {n: read_metrics(spark, f"{p}/metrics_pairs.csv") for n, p in runs.items()}
    common = materialize(stats.common_keys(list(tables.values()), "pair_id").withColumnRenamed("pair_id", "__k"), "common")
    n = common.count()
    if not n:
        raise ValueError("the runs have no pairs in common")
    lost = {name: k - n for name, t in tables.items() if (k := t.select("pair_id").distinct().count()) != n}
    long = None
    for name, t in tables.items():
        t = t.join(common, F.col("pair_id") == F.col("__k"), "left_semi")
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
        t = t.select("pair_id", "category_group", F.lit(name).alias("run"), F.explode(cells).alias("c")).select("pair_id", "category_group", "run", "c.*")
        long = t if long is None else long.unionByName(t)
    long = materialize(long.filter("value is not null"), "cells")
    ref = long.filter(F.col("run") == reference).select(F.col("pair_id").alias("__p"), F.col("metric").alias("__m"), F.col("value").alias("__v"))
    diff = long.filter(F.col("run") != reference).join(ref, (F.col("pair_id") == F.col("__p")) & (F.col("metric") == F.col("__m"))).withColumn("diff", F.col("value") - F.col("__v")).drop("__p", "__m", "__v")
    return reference, long, materialize(diff, "diff"), lost


def _differences(diff: DataFrame, group: list[str]) -> DataFrame:
    """Mean difference with interval, share of pairs where the run is higher, and whether the interval leaves out 0."""
    out = stats.bootstrap_interval(diff, "pair_id", "diff", group)
    share = diff.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.avg((F.col("diff") > 0).cast("double")).alias("share_higher"))
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    out = out.join(small_side(share), on).drop(*[f"__{g}" for g in group])
    return out.withColumn("significant", F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False)))


def compare_runs(spark: SparkSession, runs: Mapping[str, str], reference: str | None = None, by_category: bool = False, metrics: tuple[str, ...] = tuple(DIRECTIONS)) -> DataFrame:
    """Paired difference of every run with the reference run for each metric, on the pairs that all runs have, with an interval.

    ``runs``: name -> folder with ``metrics_pairs.csv``. No runs, no common pairs, and an unknown reference are errors.
    """
    _, _, diff, _ = _run_metrics(spark, runs, reference, metrics)
    return _differences(diff, ["metric", "run", *(["category_group"] if by_category else [])])


def comparison(spark: SparkSession, runs: Mapping[str, str], reference: str | None = None, by_category: bool = False, out: str | None = None, metrics: tuple[str, ...] = tuple(DIRECTIONS)) -> tuple[dict, list[str]]:
    """(document, warnings) of a comparison: per metric and run the mean with its interval, and against the reference the paired difference with interval,
    share, signed-rank p and verdict (better, worse or alike, by the metric's direction); by category the differences. Written to ``out`` if given.

    Warnings name pairs that not all runs have, and runs measured with different seeds (``metrics.json``). All results are a few rows per metric and run.
    """
    reference, long, diff, lost = _run_metrics(spark, runs, reference, metrics)
    warnings = [f"{name}: {n} pairs that not all runs have" for name, n in sorted(lost.items())]
    seeds = {n: spark.read.option("multiLine", True).schema("seed long").json(f"{p}/metrics.json").first()["seed"] for n, p in runs.items() if exists(spark, f"{p}/metrics.json")}
    if len(set(seeds.values())) > 1:
        warnings.append(f"different seeds: {seeds}")
    document: dict = {"reference": reference, "pairs": long.select("pair_id").distinct().count(), "metrics": {m: {} for m in metrics}}
    for r in stats.bootstrap_interval(long, "pair_id", "value", ["metric", "run"]).collect():
        document["metrics"][r["metric"]][r["run"]] = {"mean": r["mean"], "ci": [r["ci_low"], r["ci_high"]]}

    def entry(r) -> dict:
        good = r["mean"] * DIRECTIONS.get(r["metric"], 1) > 0
        verdict = "alike" if not r["significant"] else "better" if good else "worse"
        return {"pairs": r["n"], "mean_diff": r["mean"], "ci_low": r["ci_low"], "ci_high": r["ci_high"], "share_b_higher": r["share_higher"], "significant": r["significant"], "verdict": verdict}

    cells = {n: long.filter(F.col("run") == n) for n in runs}
    for r in _differences(diff, ["metric", "run"]).collect():
        a, b = (cells[n].filter(F.col("metric") == r["metric"]) for n in (reference, r["run"]))
        p = stats.signed_rank(a, b, "pair_id", "value").first()["p"]
        document["metrics"][r["metric"]][r["run"]]["vs_reference"] = entry(r) | {"wilcoxon_p": p}
    if by_category:
        for r in _differences(diff, ["metric", "run", "category_group"]).collect():
            document["metrics"][r["metric"]].setdefault("by_category", {}).setdefault(r["category_group"] or "", {})[r["run"]] = entry(r)
    if out:
        write_json(document, out, spark)
    return document, warnings


def write_run_metrics(spark: SparkSession, table: DataFrame, run: str, seed: int, **facts) -> dict:
    """``metrics_pairs.csv`` of a run and ``metrics.json`` with its means, their intervals and the seed it was measured with."""
    write_metrics(table, f"{run}/metrics_pairs.csv")
    stored = read_metrics(spark, f"{run}/metrics_pairs.csv")
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in DIRECTIONS])
    long = stored.select("pair_id", F.explode(cells).alias("c")).select("pair_id", "c.*")
    means = {r["metric"]: {"mean": r["mean"], "ci": [r["ci_low"], r["ci_high"]], "n": r["n"]} for r in stats.bootstrap_interval(long, "pair_id", "value", ["metric"]).collect()}
    document = {**facts, "seed": seed, "pairs": stored.count(), "metrics": means}
    write_json(document, f"{run}/metrics.json", spark)
    return document


def report_run(spark: SparkSession, run: str, value: str = "loss", window: int = 40) -> tuple[DataFrame, DataFrame]:
    """Trend of a run's log and its rolling mean."""
    log = read_log(spark, f"{run}/log.jsonl")
    return stats.run_trend(log, ["step"], "step", value), stats.rolling_mean(log, ["step"], value, window)


def plot_run(spark: SparkSession, run: str, values: tuple[str, ...] = ("loss", "loss_masked"), window: int = 40, points: int = 2000) -> str:
    """``loss.png`` of a run: each logged value, and darker its rolling mean, as means over at most ``points`` stretches of the log (a picture shows no more)."""
    lines = []
    for value, (pale, dark) in zip(values, (((214, 205, 190), (140, 110, 40)), ((190, 220, 205), (20, 110, 80)))):
        _, rolling = report_run(spark, run, value, window)
        span = rolling.agg(F.min("step"), F.max("step")).first()
        if span[0] is None:
            continue
        stretch = F.floor((F.col("step") - F.lit(span[0])) * F.lit(points) / F.lit(span[1] - span[0] + 1))
        rows = rolling.groupBy(stretch.alias("at")).agg(F.avg("step").alias("x"), F.avg(value).alias("y"), F.avg("rolling").alias("r")).orderBy("at").collect()
        x, y, r = (np.array([row[c] if row[c] is not None else np.nan for row in rows], float) for c in "xyr")
        lines += [(x, y, pale), (x, r, dark)]
    out = f"{run}/loss.png"
    write_bytes(images.png_bytes(images.line_chart(lines)), out, spark)
    return out


def inspect_stages(spark: SparkSession, roots: Roots, n: int = 8, cell: int = 260, out: str | None = None) -> tuple[int, str]:
    """A sheet of the first ``n`` frames (by id) that the parse stage has: frame, label map, and frame with mask and pose where those stages have them; (frames, path).

    Only the chosen frames' files are read on, and each picture is drawn and shrunk on the executors.
    """
    have = {s: _stage(spark, roots, s).select(F.col("image_id").alias(f"__{s}"), F.col("payload").alias(s)) for s in ("parse", "agnostic", "pose")}
    rows = _working_set(spark, roots).select("image_id", "rel_path").join(have["parse"], F.col("image_id") == F.col("__parse"))
    chosen = materialize(rows.orderBy("image_id").limit(n), "chosen")
    for s in ("agnostic", "pose"):
        chosen = chosen.join(have[s], F.col("image_id") == F.col(f"__{s}"), "left")
    chosen = _files(spark, roots).join(F.broadcast(chosen), F.col("__r") == F.col("rel_path"))  # n rows

    @F.pandas_udf("binary")
    def sheet(content: pd.Series, parse: pd.Series, mask: pd.Series, pose: pd.Series) -> pd.Series:
        def one(c, p, m, k):
            img, labels = runners.frame({"content": bytes(c)}), images.png_array(bytes(p))
            joints = json.loads(k) if k else {}
            drawn = pixels.inspection(img, labels, images.png_array(bytes(m)) if m is not None else np.zeros_like(labels), joints.get("keypoints") or {}, joints.get("scores") or {})
            return images.png_bytes(images.resample(drawn, cell, round(cell * drawn.shape[1] / drawn.shape[0]), "bicubic"))

        return pd.Series([one(*r) for r in zip(content, parse, mask, pose)])

    done = chosen.select("image_id", sheet("content", "parse", "agnostic", "pose").alias("png")).orderBy("image_id").collect()
    out = out or f"{roots.need('cache')}/inspect_preproc.png"
    if done:
        write_bytes(images.png_bytes(np.concatenate([images.png_array(bytes(r["png"])) for r in done])), out, spark)
    return len(done), out


def label_batch(spark: SparkSession, pool: DataFrame, n: int, seed: int, title: str, hint: str, classes: list[tuple[str, str]], thumbs: DataFrame | None = None) -> tuple[str, str]:
    """(batch id, page) of a stratified sample; ``thumbs`` (``rel_path``, ``thumb`` as a data URL) is joined for the sampled rows and their references only."""
    rows = materialize(labeling.stratified_sample(pool, n, seed), "sample")
    if thumbs is not None:
        for path, out in (("rel_path", "thumb"), ("ref_path", "ref_thumb")):
            if path in rows.columns:
                t = thumbs.select(F.col("rel_path").alias("__t"), F.col("thumb").alias(out))
                rows = rows.join(t, F.col(path) == F.col("__t"), "left").drop("__t")
    keep = [c for c in ("image_id", "rel_path", "category_group", "thumb", "ref_path", "ref_thumb") if c in rows.columns]
    items = [{("category" if k == "category_group" else k): v for k, v in r.asDict().items()} for r in rows.select(*keep).collect()]  # at most about n rows
    return labeling.batch_id([i["image_id"] for i in items]), labeling.label_page(title, hint, classes, items)


def _thumbnails(spark: SparkSession, roots: Roots, wanted: DataFrame) -> DataFrame:
    """``rel_path`` and ``thumb`` (data URL) of the wanted paths, made where the files are read."""

    @F.pandas_udf("string")
    def url(content: pd.Series) -> pd.Series:
        made = [images.thumbnail(None if c is None else bytes(c)) for c in content]
        return pd.Series([None if m is None else f"data:{m[0]};base64,{base64.b64encode(m[1]).decode()}" for m in made])

    files = _files(spark, roots).join(small_side(wanted.select(F.col("rel_path").alias("__p")).distinct()), F.col("__r") == F.col("__p"), "left_semi")
    return files.select(F.col("__r").alias("rel_path"), url("content").alias("thumb"))


def make_labeling_set(spark: SparkSession, roots: Roots, task: str = "all", n: int = 250, seed: int = 20260906) -> dict[str, str]:
    """A labelling page per task (``labeling.TASKS``) in the cache, named by task and batch; returns task -> path.

    The verify task needs signals, similarities and pairs; frames labelled before are left out, and items that the test set lacks come first.
    """
    tasks = list(labeling.TASKS) if task == "all" else [task]
    cache = roots.need("cache")
    items = read_table(spark, roots.table("manifest_sku.parquet")).select(F.col("sku_id").alias("__s"), "category_group")
    frames_ = read_table(spark, roots.table("manifest_images.parquet")).join(items, F.col("sku_id") == F.col("__s")).drop("__s")
    pools = dict(zip(("garment", "wild"), labeling.label_pools(frames_)))
    if "verify" in tasks:
        sim = read_table(spark, roots.table("garment_sim.parquet")).select(F.col("image_id").alias("__g"), "garment_sim")
        signals = read_table(spark, roots.table("signals.parquet")).join(sim, F.col("image_id") == F.col("__g"), "left").drop("__g")
        table = read_table(spark, roots.table("manifest_pairs.parquet"))
        garments = table.groupBy("sku_id").agg(F.min_by("garment_rel_path", "pair_id").alias("ref_path"))
        done = read_labels(spark, f"{cache}/labeling/labels_verify*.csv") if has_files(spark, f"{cache}/labeling/labels_verify*.csv") else spark.createDataFrame([], LABELS)
        covered = read_table(spark, roots.table("test_set.parquet")) if exists(spark, roots.table("test_set.parquet")) else table.limit(0)
        pools["verify"] = labeling.verify_pool(signals, garments, done, covered)
    out = {}
    for name in tasks:
        spec = labeling.TASKS[name]
        pool = pools[name] if spec.paired else pools[name].drop("ref_path")
        rows = materialize(labeling.stratified_sample(pool, n, seed), "sample")
        wanted = rows.select("rel_path")
        if spec.paired:
            wanted = wanted.unionByName(rows.select(F.col("ref_path").alias("rel_path")))
        batch, page = label_batch(spark, rows, rows.count(), seed, spec.title, spec.hint, list(spec.classes), _thumbnails(spark, roots, wanted))
        out[name] = f"{cache}/labeling/{name}_{batch}.html"
        write_text([page], out[name], spark)
    return out
