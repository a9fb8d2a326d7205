"""What each stage does with a batch of frames: the work around a model, and the stages that need none.

A runner is a function for ``stages.run_stage``: a list of row dicts in, one payload each out. Models are passed in; they
are called on the executors, in batches. Frames come as file bytes in ``content`` and are fitted into the canvas that all stages share.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np

from weftline.functions import images, pixels

# Names of the 17 joints in the order in which pose models give them, the score from which a detection counts, and the class that is kept.
KEYPOINTS = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
)
DETECTED, PERSON = 0.5, "person"
#: Width and height of the canvas.
CANVAS = (768, 1024)

Runner = Callable[[list[dict]], list]


def frame(row: dict, canvas: tuple[int, int] = CANVAS) -> np.ndarray | None:
    """The row's picture on the canvas, None if it can't be read."""
    img = images.decode(row["content"])
    return None if img is None else images.canonical(img, *canvas)


def _with_pictures(rows: list[dict], canvas: tuple[int, int], function: Callable[[list[int], list[np.ndarray]], Sequence]) -> list:
    """``function`` over the rows whose picture can be read (their places, their pictures); None for the others."""
    shown = [(i, img) for i, r in enumerate(rows) if (img := frame(r, canvas)) is not None]
    out: list = [None] * len(rows)
    if shown:
        at, pictures = (list(x) for x in zip(*shown))
        for i, payload in zip(at, function(at, pictures), strict=True):
            out[i] = payload
    return out


def detect(model: Callable[[list[np.ndarray]], list], canvas: tuple[int, int] = CANVAS) -> Runner:
    """``model``: pictures -> for each a list of (label, score, (left, top, right, bottom))."""

    def document(found: list) -> str:
        kept = [(list(map(float, box)), float(score)) for label, score, box in found if label.lower() == PERSON and score > DETECTED]
        share = [(b[2] - b[0]) * (b[3] - b[1]) / (canvas[0] * canvas[1]) for b, _ in kept]
        return json.dumps({"boxes": [b for b, _ in kept], "scores": [s for _, s in kept], "n_persons": len(kept), "max_area_frac": max(share, default=0.0)})

    return lambda rows: _with_pictures(rows, canvas, lambda _, pictures: [document(f) for f in model(pictures)])


def parse(model: Callable[[list[np.ndarray]], list[np.ndarray]], canvas: tuple[int, int] = CANVAS) -> Runner:
    """``model``: pictures -> label maps; kept as PNG."""
    return lambda rows: _with_pictures(rows, canvas, lambda _, pictures: [images.png_bytes(m) for m in model(pictures)])


def pose(model: Callable[[np.ndarray, list[float]], tuple[Sequence, Sequence]], canvas: tuple[int, int] = CANVAS) -> Runner:
    """``model``: picture and the largest person's box (left, top, width, height) -> (points, scores) of the joints. A frame without a person gets an empty document."""

    def document(row: dict, picture: np.ndarray) -> str:
        boxes = json.loads(row["detect"])["boxes"]
        if not boxes:
            return json.dumps({"keypoints": {}, "scores": {}, "box": None})
        left, top, right, bottom = box = max(boxes, key=lambda b: (b[2] - b[0]) * (b[3] - b[1]))
        points, scores = model(picture, [left, top, right - left, bottom - top])
        return json.dumps({"box": box, "keypoints": {n: [float(x) for x in p] for n, p in zip(KEYPOINTS, points)}, "scores": {n: float(s) for n, s in zip(KEYPOINTS, scores)}})

    return lambda rows: _with_pictures(rows, canvas, lambda at, pictures: [document(rows[i], p) for i, p in zip(at, pictures)])


def agnostic(grow_px: int = 12) -> Runner:
    """The mask of what a garment of the row's group covers, out of its label map."""
    return lambda rows: [images.png_bytes(pixels.agnostic_mask(images.png_array(r["parse"]), r["category_group"], grow_px)) for r in rows]


def agnostic_refined() -> Runner:
    """The mask without face and hands, out of mask, label map and pose."""

    def one(r: dict) -> bytes:
        p = json.loads(r["pose"])
        return images.png_bytes(pixels.refine_mask(images.png_array(r["agnostic"]), images.png_array(r["parse"]), p.get("keypoints") or {}, p.get("scores") or {}))

    return lambda rows: [one(r) for r in rows]


def embed(model: Callable[[list[np.ndarray]], np.ndarray], canvas: tuple[int, int] = CANVAS) -> Runner:
    """``model``: garment crops -> vectors, stored with length 1. An empty vector says that no garment was found."""

    def run(at: list[int], pictures: list[np.ndarray], rows: list[dict]) -> list:
        crops = [pixels.garment_crop(p, images.png_array(rows[i]["parse"]), rows[i]["category_group"]) for i, p in zip(at, pictures)]
        known = [c for c in crops if c is not None]
        vectors = iter(np.asarray(model(known), np.float64)) if known else iter(())
        unit = lambda v: (v / max(float(np.linalg.norm(v)), 1e-12)).astype(np.float16).astype(np.float32).tolist()
        return [[] if c is None else unit(next(vectors)) for c in crops]

    return lambda rows: _with_pictures(rows, canvas, lambda at, pictures: run(at, pictures, rows))


def colour(canvas: tuple[int, int] = CANVAS) -> Runner:
    """Lab colour features of the garment; an empty vector says that none was found."""

    def one(row: dict, picture: np.ndarray) -> list[float]:
        v = pixels.colour_features(picture, images.png_array(row["parse"]), row["category_group"])
        return [] if v is None else v.astype(np.float32).tolist()

    return lambda rows: _with_pictures(rows, canvas, lambda at, pictures: [one(rows[i], p) for i, p in zip(at, pictures)])


def latents(model: Callable[[np.ndarray], np.ndarray], canvas: tuple[int, int] = CANVAS) -> Runner:
    """``model``: pictures as a (n, 3, height, width) array in -1..1 -> one array each, stored flat."""

    def run(pictures: list[np.ndarray]) -> list:
        x = np.stack(pictures).astype(np.float32).transpose(0, 3, 1, 2) / 127.5 - 1
        return [np.asarray(v, np.float16).astype(np.float32).reshape(-1).tolist() for v in model(x)]

    return lambda rows: _with_pictures(rows, canvas, lambda _, pictures: run(pictures))


#: Stage -> (what makes its runner, whether it needs the frames' bytes, whether it needs a model).
RUNNERS = {
    "detect": (detect, True, True), "parse": (parse, True, True), "pose": (pose, True, True), "agnostic": (agnostic, False, False), "agnostic_refined": (agnostic_refined, False, False),
    "embed": (embed, True, True), "colour": (colour, True, False), "latents": (latents, True, True),
}
