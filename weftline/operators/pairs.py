"""Garment-person pairs: flat lays, cascade, pair table, arms, test set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.ids import hash_rank, pair_id
from weftline.functions.nulls import known
from weftline.operators.matching import quantile
from weftline.operators.ranking import global_index

# Calibrated thresholds of the cascade.
MIN_TORSO, MIN_AREA, MIN_SIM, COLOUR_DROP, MIN_WHITE = 0.20, 0.05, 0.30, 0.45, 0.25
ARMS = ("studio", "studio_wild", "studio_clean", "studio_random")


def flat_candidates(frames: DataFrame, min_white: float = MIN_WHITE) -> DataFrame:
    """Product frames without a person on a light background. Unknown measures don't pass."""
    return frames.filter((F.col("branch") == "product") & (known("n_persons") == 0) & (known("white_frac") >= min_white))


def best_garment(flat: DataFrame, item: str = "sku_id") -> DataFrame:
    """The lightest flat lay of each item (ties: the smallest ``image_id``): ``garment_image_id``, ``garment_rel_path``."""
    best = F.min(F.struct((-known("white_frac")).alias("w"), F.col("image_id"), F.col("rel_path")))
    return flat.groupBy(item).agg(best.alias("b")).select(item, F.col("b.image_id").alias("garment_image_id"), F.col("b.rel_path").alias("garment_rel_path"))


def cascade_steps(threshold: float | None) -> list[tuple[str, Column]]:
    """The conditions of the wild cascade in order; unknown values fail."""
    steps = [
        ("person_found", known("n_persons") >= 1),
        ("large_enough", known("area_frac") >= MIN_AREA),
        ("torso_visible", known("torso_min") >= MIN_TORSO),
        ("same_garment", known("garment_sim") >= MIN_SIM),
        ("same_colour", known("colour_rank") >= (F.lit(None).cast("double") if threshold is None else F.lit(threshold))),
    ]
    return [(n, F.coalesce(c, F.lit(False))) for n, c in steps]


def cascade_funnel(frames: DataFrame, drop: float = COLOUR_DROP) -> DataFrame:
    """``step_no``, ``step``, ``kept``: review frames that survive each further condition, in one pass."""
    wild = frames.filter("branch = 'review'")
    steps = [("review_frames", F.lit(True)), *cascade_steps(quantile(wild, "colour_rank", drop))]
    keep, sums = F.lit(True), []
    for i, (_, c) in enumerate(steps):
        keep = keep & c
        sums.append(F.coalesce(F.sum(keep.cast("long")), F.lit(0)).alias(f"s{i}"))
    one = wild.agg(*sums)
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(f"s{i}").alias("kept")) for i, (n, _) in enumerate(steps)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def build_pairs(frames: DataFrame, drop: float = COLOUR_DROP, min_white: float = MIN_WHITE) -> DataFrame:
    """The pair table: studio frames with a person and review frames that pass the cascade, each with its item's flat lay.

    ``frames`` has ``image_id, sku_id, design_id, category_group, split, branch, rel_path, n_persons,
    area_frac, torso_min, garment_sim, colour_rank, white_frac``. Items without a flat lay have no pairs.
    """
    garments = best_garment(flat_candidates(frames, min_white)).withColumnRenamed("sku_id", "__g")
    studio = frames.filter((F.col("branch") == "product") & (known("n_persons") > 0)).withColumn("arm", F.lit("studio"))
    wild = frames.filter("branch = 'review'")
    ok = F.lit(True)
    for _, c in cascade_steps(quantile(wild, "colour_rank", drop)):
        ok = ok & c
    both = studio.unionByName(wild.filter(ok).withColumn("arm", F.lit("wild")))
    out = both.join(garments, F.col("sku_id") == F.col("__g")).drop("__g").withColumnsRenamed({"image_id": "person_image_id", "rel_path": "person_rel_path"})
    columns = ["pair_id", "arm", "sku_id", "design_id", "category_group", "split", "garment_image_id", "garment_rel_path", "person_image_id", "person_rel_path", "n_persons", "area_frac", "torso_min", "garment_sim", "colour_rank"]
    return out.withColumn("pair_id", pair_id("garment_image_id", "person_image_id")).select(*columns)


def select_pairs(pairs: DataFrame, arm: str, split: str = "train", clean: float = 0.65, seed: int = 20260910, branch: str = "branch", key: str = "pair_id") -> DataFrame:
    """Pairs of an experiment arm within one split.

    ``studio``; ``studio_wild`` adds all wild pairs; ``studio_clean`` those at or above the ``clean`` quantile of
    the split's wild colour ranks; ``studio_random`` as many wild pairs as clean has, by
    hash order of the key. Pairs without colour rank are never clean.
    """
    if arm not in ARMS:
        raise ValueError(f"unknown arm {arm!r}; one of {ARMS}")
    rows = pairs.filter(F.col("split") == split)
    studio, wild = rows.filter(F.col(branch) == "studio"), rows.filter(F.col(branch) == "wild")
    if arm == "studio":
        return studio
    if arm == "studio_wild":
        return studio.unionByName(wild)
    t = quantile(wild, "colour_rank", clean)
    kept = wild.filter(F.coalesce(known("colour_rank") >= t, F.lit(False))) if t is not None else wild.limit(0)
    if arm == "studio_random":
        n = kept.count()
        kept = global_index(wild.withColumn("__h", hash_rank(key, seed)), ["__h", key], "__i").filter(F.col("__i") < n).drop("__h", "__i")
    return studio.unionByName(kept)


def test_set(frames: DataFrame, labels: DataFrame, pairs: DataFrame, accepted: str = "ok", split: str = "test") -> DataFrame:
    """Confirmed test pairs: frames labelled ``accepted`` in the split, with the garment of their item (the smallest pair's)."""
    g = pairs.groupBy("sku_id").agg(F.min(F.struct("pair_id", "garment_image_id", "garment_rel_path")).alias("g")).select(F.col("sku_id").alias("__s"), "g.garment_image_id", "g.garment_rel_path")
    ok = labels.filter(F.col("label") == accepted).select(F.col("image_id").alias("__l")).distinct()
    rows = frames.filter(F.col("split") == split).join(ok, F.col("image_id") == F.col("__l")).join(g, F.col("sku_id") == F.col("__s"))
    rows = rows.withColumnsRenamed({"image_id": "person_image_id", "rel_path": "person_rel_path"})
    return rows.withColumn("pair_id", pair_id("garment_image_id", "person_image_id")).select("pair_id", "sku_id", "category_group", "garment_image_id", "garment_rel_path", "person_image_id", "person_rel_path")


def test_set_summary(tests: DataFrame) -> DataFrame:
    return tests.groupBy("category_group").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("sku_id").alias("items"))


def missing_files(pairs: DataFrame, frames: DataFrame, sample: int | None = None, seed: int = 0) -> DataFrame:
    """``pair_id``, ``what`` of pairs whose garment or person frame isn't among the readable frames; ``sample`` checks that many pairs in hash order."""
    rows = pairs if sample is None else pairs.orderBy(hash_rank("pair_id", seed), "pair_id").limit(sample)
    have = frames.filter(F.coalesce(F.col("read_ok"), F.lit(False))).select(F.col("image_id").alias("__i")).distinct()
    sides = rows.select("pair_id", F.explode(F.array(*[F.struct(F.lit(w).alias("what"), F.col(f"{w}_image_id").alias("id")) for w in ("garment", "person")])).alias("x"))
    return sides.select("pair_id", "x.what", "x.id").join(have, F.col("id") == F.col("__i"), "left_anti").select("pair_id", "what")
