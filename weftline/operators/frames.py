"""Pixel kernels over tables of frames: Arrow batches in, columns out."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.functions import images, pixels

_QC = ["sharpness", "brightness", "contrast", "border_mean", "border_std", "white_frac"]


def frame_features(df: DataFrame, key: str = "image_id", content: str = "content", decoder: pixels.Decoder = pixels.decode) -> DataFrame:
    """Content hash, perceptual hash (64-bit pattern) and quality measures from the bytes of each frame, read once.

    Unreadable and empty frames have ``read_ok`` false and NULL measures, but keep their content hash; NULL bytes have none.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for c in b.column(1).to_pylist():
                img = decoder(c) if c else None
                row = {"content_md5": None if c is None else hashlib.md5(c).hexdigest(), "read_ok": img is not None}
                if img is not None:
                    row |= pixels.frame_features(pixels.grey(img))
                    row["phash"] = int(np.uint64(row["phash"]).view(np.int64))
                rows.append(row)
            cols = [b.column(0), *[pa.array([r.get(n) for r in rows], t) for n, t in (("content_md5", pa.string()), ("read_ok", pa.bool_()), *((n, pa.float64()) for n in _QC), ("phash", pa.int64()))]]
            yield pa.RecordBatch.from_arrays(cols, [key, "content_md5", "read_ok", *_QC, "phash"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInArrow(run, f"{key} {kind}, content_md5 string, read_ok boolean, {', '.join(f'{n} double' for n in _QC)}, phash long")


def _label_map(r: dict) -> np.ndarray | None:
    """The label map of a row: a PNG file, or ``height`` x ``width`` bytes."""
    p, h, w = r["parse"], r["height"], r["width"]
    if p is not None and p[:4] == b"\x89PNG":
        try:
            m = images.png_array(p)
            return m if m.ndim == 2 else None
        except (ValueError, TypeError, zlib.error, struct.error):
            return None
    return None if p is None or not h or not w or len(p) != h * w else np.frombuffer(p, np.uint8).reshape(h, w)


def agnostic_masks(df: DataFrame, key: str = "image_id", png: bool = False) -> DataFrame:
    """``mask`` (bytes, or a PNG file) of frames with ``parse`` (label bytes, row by row, or a PNG file), ``height``, ``width``, ``category_group`` and, if they have
    ``keypoints`` (map joint -> [x, y]) and ``scores``, without face and hands. NULL for a missing or misshapen label map.
    """
    refine = {"keypoints", "scores"} <= set(df.columns)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for r in b.to_pylist():
                p = _label_map(r)
                m = None if p is None else pixels.agnostic_mask(p, r["category_group"])
                if m is not None and refine and r["keypoints"] and r["scores"]:
                    m = pixels.refine_mask(m, p, dict(r["keypoints"]), dict(r["scores"]))
                out.append(None if m is None else images.png_bytes(m) if png else m.tobytes())
            yield pa.RecordBatch.from_arrays([b[key], pa.array(out, pa.binary())], [key, "mask"])

    cols = [key, "parse", "height", "width", "category_group", *(["keypoints", "scores"] if refine else [])]
    return df.select(*cols).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, mask binary")


def mask_measures(df: DataFrame, key: str = "image_id", to_height: int = 64, to_width: int = 48) -> DataFrame:
    """Load masks (``mask`` bytes or a PNG file, ``height``, ``width``) at a common size: share covered and box of what is set (NULL when nothing is)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            share, box = [], []
            for r in b.to_pylist():
                m = _label_map({"parse": r["mask"], "height": r["height"], "width": r["width"]})
                m = None if m is None else pixels.resize_nearest(m, to_height, to_width) > 127
                share.append(None if m is None else float(m.mean()))
                box.append(None if m is None else pixels.mask_box(m, 0))
            yield pa.RecordBatch.from_arrays([b[key], pa.array(share, pa.float64()), pa.array(box, pa.list_(pa.int32()))], [key, "share", "box"])

    return df.select(key, "mask", "height", "width").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, share double, box array<int>")


def masked_differences(df: DataFrame, key: str = "pair_id") -> DataFrame:
    """``l1_mask`` of frames ``a`` and ``b`` (RGB bytes) inside ``mask``, all of ``height`` x ``width``; NULL for an empty mask or misshapen bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in it:
            out = []
            for r in t.to_pylist():
                h, w = r["height"], r["width"]
                m = _label_map({"parse": r["mask"], "height": h, "width": w})
                a, b = r["a"], r["b"]
                ok = m is not None and a is not None and b is not None and len(a) == len(b) == h * w * 3
                out.append(pixels.masked_l1(np.frombuffer(a, np.uint8).reshape(h, w, 3), np.frombuffer(b, np.uint8).reshape(h, w, 3), m) if ok else None)
            yield pa.RecordBatch.from_arrays([t[key], pa.array(out, pa.float64())], [key, "l1_mask"])

    return df.select(key, "a", "b", "mask", "height", "width").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, l1_mask double")


def training_samples(df: DataFrame, key: str = "pair_id", seed: int = 0, flip: bool = True) -> DataFrame:
    """Arrays of training pairs: ``person`` and ``garment`` (channel first, -1..1), ``mask`` (0 or 1), flat, of frames ``person``, ``garment`` (RGB bytes) and ``mask`` of ``height`` x ``width``.

    ``index`` (a column) and ``seed`` decide which pairs are mirrored. NULL for misshapen or missing bytes.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for r in b.to_pylist():
                h, w = r["height"], r["width"]
                m = _label_map({"parse": r["mask"], "height": h, "width": w})
                ok = m is not None and all(r[c] is not None and len(r[c]) == h * w * 3 for c in ("person", "garment"))
                rgb = [np.frombuffer(r[c], np.uint8).reshape(h, w, 3) for c in ("person", "garment")] if ok else []
                out.append(pixels.training_sample(*rgb, m, r["index"], seed, flip) if ok else {})
            cols = [pa.array([None if n not in o else o[n].reshape(-1) for o in out], pa.list_(pa.float32())) for n in ("person", "garment", "mask")]
            yield pa.RecordBatch.from_arrays([b[key], *cols], [key, "person", "garment", "mask"])

    return df.select(key, "index", "person", "garment", "mask", "height", "width").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, person array<float>, garment array<float>, mask array<float>")


def garment_vectors(df: DataFrame, key: str = "image_id", decoder: pixels.Decoder = pixels.decode, embed=None) -> DataFrame:
    """Vector of each frame's garment: ``embed(crop)``, by default its Lab colour features. An empty vector means no garment was found, NULL that an input is missing.

    ``df``: ``key``, ``content``, ``parse``, ``height``, ``width`` (of the label map and the frame), ``category_group``.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for r in b.to_pylist():
                p, img = _label_map(r), decoder(r["content"])
                if p is None or img is None or img.shape[:2] != p.shape or r["category_group"] not in pixels.GARMENT:
                    out.append(None)
                    continue
                if embed is None:
                    v = pixels.colour_features(img, p, r["category_group"])
                else:
                    crop = pixels.garment_crop(img, p, r["category_group"])
                    v = None if crop is None else embed(crop)
                out.append([] if v is None else np.asarray(v, np.float32).tolist())
            yield pa.RecordBatch.from_arrays([b[key], pa.array(out, pa.list_(pa.float32()))], [key, "vector"])

    return df.select(key, "content", "parse", "height", "width", "category_group").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, vector array<float>")
