"""Queries of the core library: name -> callable(spark, dir), and equivalent SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import ids, vectors
from weftline.functions.nulls import known
from weftline.operators import assets, catalog, copies, labeling, matching, pairs, splits, stages, stats, tables, wide
from weftline.operators import frames as pixel_frames
from weftline.operators.ranking import percent_rank_average
from weftline.plans.durable import materialize
from weftline.sources.directory import probe_headers
from weftline.sources.json_attributes import attribute_rows

# Raw categories of the item tables by garment group.
CATEGORIES = {
    "upper": ["Вязаный верх", "Жакетный ряд", "Рубашки повседневные", "Трикотажные топы", "Уютный верх"],
    "lower": ["Низ из денима", "Низ классический"],
    "dress": ["Платья на каждый день", "Платья нарядные"],
    "outer": ["Верх для улицы"],
    "fullbody": ["Цельный крой"],
    "drop": ["Для пляжа", "Домашний ряд"],
}
TARGETS = ("upper", "lower", "dress", "outer")


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _frames(s, d):
    return tables.frames(_t(s, d, "manifest_images"))


def _items(s, d):
    return tables.items(_t(s, d, "manifest_sku"))


def _pairs(s, d):
    return tables.pairs(_t(s, d, "manifest_pairs"))


def _joined(s, d):
    """Frames with the design and category of their item."""
    i = _items(s, d).select(F.col("sku_id").alias("__i"), "design_id", "category_raw", "category_group")
    return _frames(s, d).join(i, F.col("sku_id") == F.col("__i")).drop("__i")


def _annotated(s, d):
    """Annotated frames, cut once: the joined frames are read for the facts of each content and for the rows."""
    return copies.annotate_copies(materialize(_joined(s, d), "joined"))


def _signals(s, d):
    """Frames with the signals of the pairs in which they are the person; frames used as garment have no person."""
    p = _pairs(s, d)
    cols = ["n_persons", "area_frac", "torso_min", "garment_sim", "colour_rank"]
    person = p.groupBy(F.col("person_image_id").alias("__p")).agg(*[F.max(c).alias(c) for c in cols])
    garment = p.select(F.col("garment_image_id").alias("__g")).distinct()
    f = _joined(s, d).join(person, F.col("image_id") == F.col("__p"), "left").join(garment, F.col("image_id") == F.col("__g"), "left")
    return f.withColumn("n_persons", F.coalesce("n_persons", F.when(F.col("__g").isNotNull(), 0.0))).drop("__p", "__g")


def _labels(s, d):
    """A label per person frame, by hash of its id: the tables hold no labels of people."""
    p = _pairs(s, d).select(F.col("person_image_id").alias("image_id")).distinct()
    n = ids.shard_of("image_id", 4)
    return p.select("image_id", F.when(n < 2, "ok").when(n == 2, "wrong_colour").otherwise("not_visible").alias("label"), ids.shard_of(F.concat(F.lit("b"), "image_id"), 3).alias("batch"))


def _wide(s, d):
    i = _t(s, d, "manifest_sku")
    return wide.widen(i, "sku_id", attribute_rows(i, "sku_id", "attrs_json"), _t(s, d, "attr_dict"))


def _merged(s, d):
    return catalog.merge_pairs(_t(s, d, "events"), "user_id", "event_type", "props", "event_id")


def _attrs(s, d):
    return catalog.as_map(_merged(s, d), "user_id", "event_type", "props")


def _hamming(s, d):
    f = _frames(s, d).filter("phash is not null and read_ok")
    first = f.groupBy(F.col("sku_id").alias("__s")).agg(F.min(F.struct("image_id", "phash")).alias("f")).select("__s", F.col("f.phash").alias("h"))
    return f.join(first, F.col("sku_id") == F.col("__s")).select("image_id", ids.hamming("phash", "h").cast("long").alias("bits"))


def _components(s, d):
    return copies.linked_designs(materialize(_annotated(s, d).select("content_md5", "design_id", "branch", "is_template"), "annotated"))


def _grouped_items(s, d):
    c = materialize(_components(s, d), "groups").withColumnRenamed("design_id", "__d")
    return _items(s, d).join(c, F.col("design_id") == F.col("__d"), "left").drop("__d")


def _assigned(s, d):
    return splits.stratified_splits(splits.group_mode(_grouped_items(s, d)))


def _split_items(s, d):
    items = materialize(_grouped_items(s, d), "items")
    a = splits.stratified_splits(splits.group_mode(items)).select(F.col("split_group").alias("__g"), "split")
    return items.drop("split").join(a, F.col("split_group") == F.col("__g"), "left").drop("__g")


def _vectors(s, d):
    return _t(s, d, "embeddings")


def _similarity(s, d):
    """Vectors with a positive first component are references, the others queries; the label is their item."""
    v = _vectors(s, d)
    bank = matching.reference_bank(v, "label", "embedding", "embedding[0] > 0")
    return matching.max_similarity(v.filter("not embedding[0] > 0"), bank, "vec_id", "label", "embedding")


def _dots(s, d):
    """Inner product of each vector with the first vector of its label."""
    v = _vectors(s, d)
    first = v.groupBy(F.col("label").alias("__l")).agg(F.min_by("embedding", "vec_id").alias("first"))
    return v.join(first, F.col("label") == F.col("__l")).select("vec_id", _r(vectors.dot("embedding", "first"), 5).alias("product"))


def _boxes(s, d):
    """Detections out of vectors: four boxes each, with label and score."""
    v = _vectors(s, d).select("vec_id", F.col("embedding").alias("e"))
    box = lambda k: F.array(*[F.bround((F.abs(F.col("e")[4 * k + j].cast("double")) + (1 if j > 1 else 0)) * 100) for j in range(4)])
    det = [F.struct(F.when(F.col("e")[20 + k] > 0, "person").otherwise("bag").alias("label"), (F.abs(F.col("e")[30 + k].cast("double")) * 5).alias("score"), box(k).alias("box")) for k in range(4)]
    return v.select("vec_id", F.array(*det).alias("det"))


def _scores(s, d):
    joints = [*vectors.TORSO, "nose"]
    v = _vectors(s, d)
    entries = F.array(*[F.struct(F.lit(j).alias("key"), (F.abs(F.col("embedding")[k].cast("double")) * 4).alias("value")) for k, j in enumerate(joints)])
    return v.select("vec_id", F.map_from_entries(F.filter(entries, lambda x: x["value"] > 0.02)).alias("scores"))


def _detected(s, d):
    b = _boxes(s, d).withColumn("kept", vectors.detections_kept("det"))
    return b.select("vec_id", F.size("kept").cast("long").alias("n_persons"), _r(vectors.largest_fraction("kept", F.lit(300.0), F.lit(300.0))).alias("area_frac"))


def _runs(s, d):
    li = _t(s, d, "lineitem")
    per = li.groupBy("l_linestatus", F.col("l_partkey").alias("pair_id"), (F.col("l_partkey") % 4).alias("category")).agg(F.avg("l_discount").alias("score"))
    return per.filter("l_linestatus = 'O'"), per.filter("l_linestatus = 'F'")


def _test_set(s, d):
    return pairs.test_set(_signals(s, d), _labels(s, d), _pairs(s, d))


def _filter_quality(s, d):
    """How well the colour filter tells person frames labelled ok from those labelled wrong_colour; its threshold is the .45 quantile of all pairs."""
    p = materialize(_pairs(s, d), "pairs")
    labels = _labels(s, d).filter("label in ('ok', 'wrong_colour')").select(F.col("image_id").alias("__l"), (F.col("label") == "ok").alias("positive"))
    marked = p.join(labels, F.col("person_image_id") == F.col("__l"))
    return matching.filter_quality(marked, "positive", "colour_rank", quantile_of=p).select("tp", "fp", "fn", _r("precision").alias("precision"), _r("recall").alias("recall"))


def _verify(s, d):
    p = _pairs(s, d)
    garments = p.groupBy("sku_id").agg(F.min("garment_rel_path").alias("ref_path"))
    done = _labels(s, d).filter("label = 'wrong_colour'")
    covered = p.filter(ids.shard_of("sku_id", 3) == 0)
    return labeling.verify_pool(_signals(s, d), garments, done, covered).select("image_id", "sku_id", "ref_path", "new_item")


def _pool(s, d, which):
    a = _annotated(s, d)
    return labeling.label_pools(a)[which]


def _letterbox(s, d):
    g = vectors.letterbox("width", "height")
    return _frames(s, d).select("image_id", *[(_r(c) if n == "scale" else c).alias(n) for n, c in g.items()])


def _bootstrap(s, d):
    a, b = _runs(s, d)
    return stats.bootstrap_interval(a.unionByName(b), "pair_id", "score", ["l_linestatus"])


def _poisson(s, d):
    a, b = _runs(s, d)
    return stats.poisson_interval(a.unionByName(b), "pair_id", "score", ["l_linestatus"])


@F.pandas_udf(T.BinaryType())
def _webp_head(width: pd.Series, height: pd.Series) -> pd.Series:
    """First bytes of an extended WebP file of a given size: the tables hold no files."""
    size = lambda n: int(n - 1).to_bytes(3, "little")
    return pd.Series([None if not (w > 0 and h > 0) else b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + size(w) + size(h) for w, h in zip(width, height)])


def _headers(s, d):
    f = _frames(s, d).select("image_id", F.when((F.col("width") > 0) & (F.col("height") > 0), _webp_head("width", "height")).alias("content"))
    return probe_headers(f).select("image_id", "width", "height", "corrupt")


@F.pandas_udf(T.BinaryType())
def _picture(v: pd.Series) -> pd.Series:
    """A grey picture of 48 x 48 pixels out of a vector."""

    def draw(x):
        x = np.asarray(x, float).reshape(8, 8)
        x = (x - x.min()) / max(1e-9, x.max() - x.min()) * 255
        return b"P5 48 48 255\n" + np.kron(x, np.ones((6, 6))).astype(np.uint8).tobytes()

    return v.map(draw)


def _pictures(s, d):
    return _vectors(s, d).select(F.col("vec_id").alias("image_id"), _picture("embedding").alias("content"))


@F.pandas_udf(T.BinaryType())
def _label_bytes(v: pd.Series) -> pd.Series:
    """A 48 x 48 label map out of a vector."""
    return v.map(lambda x: np.kron((np.abs(np.asarray(x, float)) * 60).astype(np.uint8).reshape(8, 8) % 18, np.ones((6, 6), np.uint8)).astype(np.uint8).tobytes())


def _parsed(s, d):
    size = [F.lit(48).alias("height"), F.lit(48).alias("width")]
    v = _vectors(s, d).select(F.col("vec_id").alias("image_id"), _picture("embedding").alias("content"), _label_bytes("embedding").alias("parse"), *size, F.when(F.col("label") < 5, "upper").otherwise("lower").alias("category_group"))
    return v


def _masks(s, d):
    m = pixel_frames.agnostic_masks(_parsed(s, d), png=True).select("image_id", "mask", F.lit(48).alias("height"), F.lit(48).alias("width"))
    return pixel_frames.mask_measures(m).select("image_id", _r("share").alias("share"), F.array_join(F.col("box").cast("array<string>"), ",").alias("box"))


def _posed(s, d):
    """Label maps with joints out of the vector: wrists, elbows, nose and shoulders somewhere in the picture, each with a score."""
    joints = ["left_elbow", "left_wrist", "right_elbow", "right_wrist", "nose", "left_shoulder", "right_shoulder"]
    at = lambda i: F.abs(_e(i)) * 160 % 48
    points = F.map_from_arrays(F.array(*[F.lit(j) for j in joints]), F.array(*[F.array(at(2 * i), at(2 * i + 1)) for i in range(len(joints))]))
    scores = F.map_from_arrays(F.array(*[F.lit(j) for j in joints]), F.array(*[F.abs(_e(20 + i)) * 4 for i in range(len(joints))]))
    v = _vectors(s, d).select(F.col("vec_id").alias("__v"), points.alias("keypoints"), scores.alias("scores"))
    return _parsed(s, d).join(v, F.col("image_id") == F.col("__v")).drop("__v")


def _e(i: int) -> Column:
    return F.col("embedding")[i].cast("double")


def _refined(s, d):
    m = pixel_frames.agnostic_masks(_posed(s, d)).select("image_id", "mask", F.lit(48).alias("height"), F.lit(48).alias("width"))
    return pixel_frames.mask_measures(m, to_height=48, to_width=48).select("image_id", _r("share").alias("share"))


def _masked_l1(s, d):
    """Difference of each picture from the one turned upside down, inside its mask."""
    p = _parsed(s, d)
    pictures = p.select("image_id", F.substring("content", 14, 48 * 48).alias("grey"))
    m = pixel_frames.agnostic_masks(p).withColumnRenamed("image_id", "__m")
    both = pictures.join(m, F.col("image_id") == F.col("__m")).select("image_id", _three("grey").alias("a"), _three(_reversed("grey")).alias("b"), "mask", F.lit(48).alias("height"), F.lit(48).alias("width"))
    return pixel_frames.masked_differences(both, "image_id").select("image_id", _r("l1_mask").alias("l1_mask"))


@F.pandas_udf(T.BinaryType())
def _three(v: pd.Series) -> pd.Series:
    """Grey bytes as three equal samples each."""
    return v.map(lambda x: np.repeat(np.frombuffer(x, np.uint8), 3).tobytes())


def _samples(s, d):
    """Training arrays of each picture with the one turned upside down as garment; their first row, as digits."""
    p = _parsed(s, d)
    m = pixel_frames.agnostic_masks(p).withColumnRenamed("image_id", "__m")
    pictures = p.select("image_id", F.substring("content", 14, 48 * 48).alias("grey")).join(m, F.col("image_id") == F.col("__m"))
    rows = pictures.select("image_id", F.col("image_id").cast("int").alias("index"), _three("grey").alias("person"), _three(_reversed("grey")).alias("garment"), "mask", F.lit(48).alias("height"), F.lit(48).alias("width"))
    first = lambda c: _r(F.col(c)[0].cast("double"), 5).alias(c)
    return pixel_frames.training_samples(rows, "image_id").select("image_id", first("person"), first("garment"), F.aggregate("mask", F.lit(0.0), lambda a, x: a + x).alias("masked"), F.size("person").alias("size"))


@F.pandas_udf(T.BinaryType())
def _reversed(v: pd.Series) -> pd.Series:
    return v.map(lambda x: bytes(x)[::-1])


def _colour(s, d):
    v = pixel_frames.garment_vectors(_parsed(s, d)).select("image_id", "vector")
    return v.select("image_id", F.size("vector").alias("dimensions"), *[_r(F.get("vector", F.lit(i)).cast("double"), 3).alias(n) for i, n in enumerate(("l", "a", "b"))], F.round(F.array_max(F.slice("vector", 4, 512)).cast("double"), 4).alias("fullest"))


def _staged(s, d):
    """The parse and embed stages through the stage runner, with a deterministic stand-in for the model: mean and greatest value of a picture's bytes."""
    parse = stages.run_stage(_pictures(s, d), "parse", {}, lambda batch: [r["content"][13:] for r in batch])
    embed = stages.run_stage(_pictures(s, d).select("image_id"), "embed", {"parse": parse}, lambda batch: [[sum(r["parse"]) / len(r["parse"]), float(max(r["parse"]))] for r in batch])
    return embed.select("image_id", _r(F.col("payload")[0].cast("double"), 3).alias("mean"), F.col("payload")[1].cast("double").alias("greatest"))


def _entry(s, d):
    """Working set per group and branch: the flagship pipeline from raw rows to countable frames."""
    w = stages.working_set(_annotated(s, d).drop("category_group"), _items(s, d))
    return w.groupBy("category_group", "branch").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("design_id").alias("designs"))


def queries():
    p = lambda f, *c: lambda s, d: f(s, d).select(*c)
    q = {
        "p5_found": lambda s, d: wide.filled_cells(_wide(s, d), "sku_id"),
        "p5_wide": _wide,
        # identities and scalars
        "content_hash": lambda s, d: _t(s, d, "documents").select("doc_id", ids.content_hash("text").alias("hash")),
        "hash_rank": lambda s, d: _items(s, d).select("sku_id", _r(ids.hash_rank("sku_id", 7), 9).alias("place")),
        "shard_of": lambda s, d: _frames(s, d).groupBy(ids.shard_of("image_id", 8).alias("shard")).agg(F.count(F.lit(1)).alias("frames")),
        "pair_seed": lambda s, d: _pairs(s, d).select("pair_id", ids.pair_seed("pair_id", 3).alias("seed")),
        "hamming": _hamming,
        "split_variant": lambda s, d: _items(s, d).select("sku_id", ids.base_title("folder").alias("base"), ids.variant_number("folder").alias("variant")),
        "design_key": lambda s, d: _items(s, d).select("sku_id", ids.design_key("folder").alias("design")),
        "path_nfc": lambda s, d: _frames(s, d).select("image_id", ids.nfc("rel_path").alias("path")),
        "short_ids": lambda s, d: _frames(s, d).select("image_id", ids.short_id("rel_path").alias("short"), ids.blake_rank("sku_id", 20260906).alias("place"), ids.blake_shard("image_id", 8).alias("shard"), ids.blake_seed("image_id", 3).alias("seed")),
        "aspect_ratio": lambda s, d: _frames(s, d).select("image_id", _r(vectors.aspect("width", "height")).alias("aspect")),
        "letterbox_geometry": _letterbox,
        "pixel_normalise": lambda s, d: _frames(s, d).filter("width is not null").select("image_id", _r(vectors.pixel_normalise(F.col("width") % 256)).alias("value")),
        "json_extract": lambda s, d: _t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")),
        # frames
        "probe_headers": _headers,
        "frame_features": lambda s, d: pixel_frames.frame_features(_pictures(s, d)).select("image_id", "read_ok", "content_md5", _r("sharpness").alias("sharpness"), "phash"),
        "mask_load": _masks,
        "agnostic_refined": _refined,
        "masked_l1": _masked_l1,
        "training_samples": _samples,
        "garment_vectors": _colour,
        "run_stage": _staged,
        # metadata
        "kv_merge": _merged,
        "kv_pivot": lambda s, d: _attrs(s, d).select("user_id", *catalog.pivot_keys("attrs", {"click": "clicks", "view": "views"})),
        "kv_residual": lambda s, d: _attrs(s, d).select("user_id", catalog.residual_json("attrs", ["click", "view"]).alias("rest")),
        "category_map": lambda s, d: _items(s, d).select("sku_id", catalog.category_group("category_raw", CATEGORIES).alias("mapped")),
        # inventory
        "asset_ordering": lambda s, d: assets.order_assets(_frames(s, d)).select("image_id", "order_idx", "is_last_product"),
        "design_variants": lambda s, d: assets.count_variants(_items(s, d)).select("sku_id", "design_variants"),
        "group_inventory": lambda s, d: assets.inventory(_items(s, d), _frames(s, d)),
        "health_counts": lambda s, d: assets.health(_frames(s, d), {"corrupt": "corrupt", "unread": "not read_ok", "unchecked": "read_ok is null", "no_hash": "phash is null", "no_split": "split is null"}),
        "distinct_counts": lambda s, d: assets.distinct_counts(_items(s, d), ["sku_id", "design_id", "category_raw"]),
        # copies, working set
        "dup_annotate": p(_annotated, "image_id", "dup_designs", "is_template", "label_ok", "is_canonical"),
        "working_set": lambda s, d: stages.working_set(_annotated(s, d).drop("category_group"), _items(s, d)).select("image_id", "sku_id", "category_group"),
        "working_set_counts": _entry,
        "pending_rows": lambda s, d: stages.pending_rows(_frames(s, d), _frames(s, d).filter("phash is not null")).select("image_id", ids.shard_of("image_id", 4).alias("shard")),
        "missing_inputs": lambda s, d: stages.missing_inputs(_frames(s, d), "agnostic_refined", {"agnostic": _frames(s, d).filter("width > 500"), "parse": _frames(s, d).filter("height > 600"), "pose": _frames(s, d).filter("branch = 'review'")}),
        "qc_join": lambda s, d: stages.join_features(_frames(s, d), _frames(s, d).filter("read_ok").select("image_id", (F.col("sharpness") * 2).alias("sharpness"))).select("image_id", "sharpness"),
        "design_components": _components,
        # splits
        "group_mode": lambda s, d: splits.group_mode(_grouped_items(s, d)),
        "split_assign": lambda s, d: _assigned(s, d).select("split_group", "category_group", "n_sku", "split"),
        "split_counts": lambda s, d: splits.split_counts(_assigned(s, d)),
        "leak_check": lambda s, d: splits.leak_check(_frames(s, d).filter("branch = 'product'")),
        "leak_overlap": lambda s, d: splits.overlap(_pairs(s, d).filter("split = 'test'"), _pairs(s, d).filter("split <> 'test'"), "sku_id"),
        "crosstab_split": lambda s, d: stats.crosstab(_split_items(s, d), ["category_group"], "split", ["train", "val", "test"]),
        "persons_crosstab": lambda s, d: stats.crosstab(_pairs(s, d).withColumn("persons", F.least("n_persons", F.lit(3.0)).cast("int")), ["branch"], "persons", [0, 1, 2, 3]),
        "quality_percentiles": lambda s, d: stats.group_quantiles(_frames(s, d), "branch", "sharpness", [0.05, 0.1, 0.5, 0.9]),
        # vectors
        "reference_bank": lambda s, d: matching.bank_sizes(matching.reference_bank(_vectors(s, d), "label", "embedding", "embedding[0] > 0")),
        "max_similarity": lambda s, d: _similarity(s, d).select("vec_id", _r("garment_sim", 5).alias("garment_sim")),
        "dot_product": _dots,
        "l2_normalise": lambda s, d: _vectors(s, d).select("vec_id", _r(vectors.l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 3))[0], 5).alias("first")),
        "torso_visible": lambda s, d: _scores(s, d).select("vec_id", vectors.torso_visible("scores").alias("visible"), _r(vectors.torso_min("scores"), 5).alias("torso_min")),
        "largest_box": lambda s, d: _boxes(s, d).select("vec_id", vectors.largest_box(F.transform("det", lambda x: x["box"]))[0].alias("x0"), vectors.largest_box(F.transform("det", lambda x: x["box"]))[3].alias("y1")),
        "detect_summary": _detected,
        "collect_signals": lambda s, d: stages.collect_signals(_vectors(s, d).select("vec_id"), _detected(s, d).filter("n_persons > 0"), _scores(s, d).filter(vectors.torso_visible("scores")), "vec_id").withColumn("torso_min", _r("torso_min", 5)),
        # ranks and thresholds
        "pct_rank": lambda s, d: percent_rank_average(_pairs(s, d), "garment_sim").select("pair_id", _r("pct", 9).alias("pct")),
        "colour_rank_lowest": lambda s, d: matching.colour_rank(_pairs(s, d), "area_frac", "torso_min").select("pair_id", _r("colour_rank", 9).alias("colour_rank")),
        "colour_rank_skip": lambda s, d: matching.colour_rank(_pairs(s, d), "area_frac", "torso_min", nulls="skip").select("pair_id", _r("colour_rank", 9).alias("colour_rank")),
        "colour_threshold": lambda s, d: matching.exact_quantiles(_pairs(s, d).filter("branch = 'wild'"), "colour_rank", [0.45]).select("q", _r("value").alias("threshold")),
        "auc": lambda s, d: matching.auc(_pairs(s, d).withColumn("p", F.col("branch") == "wild"), "p", "garment_sim").select(_r("auc").alias("auc"), "n_pos", "n_neg"),
        "similarity_auc": lambda s, d: matching.auc(_similarity(s, d).withColumn("p", F.col("label") < 5), "p", "garment_sim").select(_r("auc").alias("auc"), "n_pos", "n_neg"),
        "threshold_sweep": lambda s, d: matching.threshold_sweep(_pairs(s, d).withColumn("p", F.col("branch") == "wild"), "p", "garment_sim").select("step", _r("threshold").alias("threshold"), "kept", _r("precision").alias("precision"), _r("recall").alias("recall")),
        "filter_quality": _filter_quality,
        # pairs
        "flat_candidates": lambda s, d: pairs.flat_candidates(_signals(s, d)).select("image_id", "sku_id"),
        "best_garment": lambda s, d: pairs.best_garment(pairs.flat_candidates(_signals(s, d))),
        "cascade_funnel": lambda s, d: pairs.cascade_funnel(materialize(_signals(s, d), "signals")),
        "build_pairs": lambda s, d: pairs.build_pairs(materialize(_signals(s, d), "signals")).select("pair_id", "arm", "sku_id", "garment_image_id", "person_image_id"),
        "test_set": lambda s, d: _test_set(s, d).select("pair_id", "sku_id", "garment_rel_path"),
        "test_set_summary": lambda s, d: pairs.test_set_summary(_test_set(s, d)),
        "check_inputs": lambda s, d: pairs.missing_files(_pairs(s, d), _frames(s, d)),
        # labelling
        "stratified_sample": lambda s, d: labeling.stratified_sample(_pairs(s, d), 250, 20260906, "category_group", "pair_id").select("pair_id", "category_group"),
        "verify_pool": _verify,
        "label_pool_garment": lambda s, d: _pool(s, d, 0).select("image_id"),
        "label_pool_wild": lambda s, d: _pool(s, d, 1).select("image_id", "ref_path"),
        "label_merge": lambda s, d: labeling.merge_labels(_labels(s, d).unionByName(_labels(s, d).withColumn("label", F.lit("late")).withColumn("batch", F.lit(1)))),
        # run comparison
        "common_pairs": lambda s, d: stats.common_keys(list(_runs(s, d)), "pair_id"),
        "metrics_mean": lambda s, d: stats.metric_means(_pairs(s, d), ["area_frac", "torso_min", "garment_sim"], ["branch"]).select("branch", *[_r(c).alias(c) for c in ("area_frac", "torso_min", "garment_sim")]),
        "paired_compare": lambda s, d: stats.paired_compare(*_runs(s, d), "pair_id", "score").select("pairs", _r("mean_diff").alias("mean_diff"), _r("share_b_higher").alias("share_b_higher")),
        "compare_by_category": lambda s, d: stats.paired_compare(*_runs(s, d), "pair_id", "score", ["category"]).select("category", "pairs", _r("mean_diff").alias("mean_diff"), _r("share_b_higher").alias("share_b_higher")),
        "bootstrap_ci": _bootstrap,
        "paired_report": lambda s, d: stats.paired_report(*_runs(s, d), "pair_id", "score"),
        "poisson_ci": _poisson,
        "signed_rank": lambda s, d: stats.signed_rank(*_runs(s, d), "pair_id", "score").select("n", _r("w_plus", 3).alias("w_plus"), _r("z", 4).alias("z")),
        "run_trend": lambda s, d: stats.run_trend(_t(s, d, "events"), ["ts", "event_id"], "event_id", "value").select("rows", *[_r(c).alias(c) for c in ("head", "tail", "change", "error", "slope_10k")], "significant"),
        "rolling_mean": lambda s, d: stats.rolling_mean(_t(s, d, "events").select("event_id", "ts", "value"), ["ts", "event_id"], "value", block=20_000).select("event_id", _r("rolling").alias("rolling")),
    }
    for arm in pairs.ARMS:
        q[f"select_pairs_{arm}"] = lambda s, d, arm=arm: pairs.select_pairs(_pairs(s, d), arm).select("pair_id", "branch")
    return q


def oracle_sql():
    from weftline.oracles import SQL

    return SQL
