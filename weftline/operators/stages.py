"""Per-frame stages: registry, working set, pending rows, running a stage, assembling signals."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.ids import shard_of


@dataclass(frozen=True)
class Stage:
    """A per-frame computation: what it writes and which stages must have run on a frame before it."""

    name: str
    needs: tuple[str, ...] = ()
    schema: str = "payload binary"


# The stages and what each one needs.
STAGES = {s.name: s for s in (
    Stage("detect", (), "payload string"),
    Stage("parse", (), "payload binary"),
    Stage("pose", ("detect",), "payload string"),
    Stage("agnostic", ("parse",), "payload binary"),
    Stage("agnostic_refined", ("agnostic", "parse", "pose"), "payload binary"),
    Stage("embed", ("parse",), "payload array<float>"),
    Stage("colour", ("parse",), "payload array<float>"),
    Stage("latents", (), "payload array<float>"),
)}


def stage_order(stages: Mapping[str, Stage] = STAGES) -> list[str]:
    """Stages so that each comes after what it needs; a cycle or an unknown need is an error."""
    done: list[str] = []
    while len(done) < len(stages):
        ready = [s.name for s in stages.values() if s.name not in done and all(n in done for n in s.needs)]
        if not ready:
            raise ValueError("stages need each other or something unknown: " + ", ".join(sorted(set(stages) - set(done))))
        done += ready
    return done


def working_set(frames: DataFrame, items: DataFrame, groups: tuple[str, ...] = ("upper", "lower", "dress", "outer"), item: str = "sku_id", group: str = "category_group") -> DataFrame:
    """Readable, canonical frames with a trusted label, no templates, of items in the given groups. NULL flags count as false."""
    ok = F.lit(True)
    for c in ("read_ok", "is_canonical", "label_ok"):
        ok = ok & F.coalesce(F.col(c), F.lit(False))
    kept = frames.filter(ok & ~F.coalesce(F.col("is_template"), F.lit(True)))
    target = items.select(F.col(item).alias("__i"), group).filter(F.col(group).isin(list(groups)))
    return kept.join(target, F.col(item) == F.col("__i")).drop("__i")


def pending_rows(rows: DataFrame, done: DataFrame | None, key: str = "image_id", shard: int = 0, shards: int = 1, overwrite: bool = False) -> DataFrame:
    """Rows of a shard whose result isn't there yet; all of the shard's with ``overwrite``."""
    if shards > 1:
        rows = rows.filter(shard_of(key, shards) == shard)
    if overwrite or done is None:
        return rows
    return rows.join(done.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def missing_inputs(rows: DataFrame, stage: str, outputs: Mapping[str, DataFrame], key: str = "image_id") -> DataFrame:
    """``key``, ``missing`` (name) of inputs that a stage still lacks: rows are reported, never skipped in silence."""
    parts = []
    for need in STAGES[stage].needs:
        have = outputs[need].select(F.col(key).alias("__k"))
        parts.append(rows.select(key).join(have, F.col(key) == F.col("__k"), "left_anti").withColumn("missing", F.lit(need)))
    out = rows.select(key).limit(0).withColumn("missing", F.lit(None).cast("string"))
    for p in parts:
        out = out.unionByName(p)
    return out


def run_stage(rows: DataFrame, stage: str, outputs: Mapping[str, DataFrame], function: Callable[[list[dict]], list], key: str = "image_id", batch: int = 64) -> DataFrame:
    """``key`` and ``payload`` of a stage for the rows whose inputs are all there.

    Outputs of the needed stages are joined as columns named after them; ``function``
    gets batches of dicts and gives one payload each (None: nothing found).
    It may load its model on first use; it runs in Arrow batches on the executors.
    """
    s = STAGES[stage]
    for need in s.needs:
        have = outputs[need].select(F.col(key).alias("__k"), F.col("payload").alias(need))
        rows = rows.join(have, F.col(key) == F.col("__k")).drop("__k")
    kind = s.schema.split(" ", 1)[1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = {"string": pa.string(), "binary": pa.binary(), "array<float>": pa.list_(pa.float32())}[kind]
        for b in it:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([part[key], pa.array(function(part.to_pylist()), to)], [key, "payload"])

    key_kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {key_kind}, payload {kind}")


def join_features(frames: DataFrame, features: DataFrame, key: str = "image_id") -> DataFrame:
    """Features beside their frames by key (never by position); columns the frames had from an earlier run are replaced."""
    new = [c for c in features.columns if c != key]
    right = features.select(F.col(key).alias("__k"), *new)
    return frames.drop(*new).join(right, F.col(key) == F.col("__k"), "left").drop("__k")


def collect_signals(rows: DataFrame, detections: DataFrame, poses: DataFrame, key: str = "image_id") -> DataFrame:
    """``n_persons``, ``area_frac``, ``torso_min`` beside each row; NULL where the stage hasn't run.

    ``detections``: ``key``, ``n_persons``, ``area_frac``. ``poses``: ``key``, ``scores`` (map of joint to score).
    """
    from weftline.functions.vectors import torso_min

    d = detections.select(F.col(key).alias("__d"), F.col("n_persons").cast("double").alias("n_persons"), F.col("area_frac").cast("double").alias("area_frac"))
    p = poses.select(F.col(key).alias("__p"), torso_min("scores").alias("torso_min"))
    return rows.join(d, F.col(key) == F.col("__d"), "left").join(p, F.col(key) == F.col("__p"), "left").drop("__d", "__p")
