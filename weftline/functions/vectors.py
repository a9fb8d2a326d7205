"""Array, map and geometry expressions. Everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Joints that must be seen for a torso to count.
TORSO = ("left_shoulder", "right_shoulder", "left_hip", "right_hip")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision; NULL if a side is NULL or the lengths differ, 0 for empty vectors."""
    a, b = _c(a), _c(b)
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), s)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column | str) -> Column:
    """Vector of length 1; NULL for NULL or a zero vector, an empty vector stays empty."""
    n = l2_norm(v)
    return F.when(F.size(_c(v)) == 0, F.transform(_c(v), lambda x: x.cast("double"))).when(n > 0, F.transform(_c(v), lambda x: x.cast("double") / n))


def score_of(scores: Column | str, joint: str) -> Column:
    """Score of a joint in a map, 0 when missing."""
    return F.coalesce(F.try_element_at(_c(scores), F.lit(joint)), F.lit(0.0))


def torso_visible(scores: Column | str, least: float = 0.3) -> Column:
    """All four torso joints reach ``least``; missing ones count as 0."""
    ok = F.lit(True)
    for j in TORSO:
        ok = ok & (score_of(scores, j) >= least)
    return ok


def torso_min(scores: Column | str) -> Column:
    return F.least(*[score_of(scores, j) for j in TORSO])


def box_area(box: Column) -> Column:
    """Area of [x0, y0, x1, y1]."""
    return (box[2] - box[0]) * (box[3] - box[1])


def largest_box(boxes: Column | str) -> Column:
    """Box of the greatest area (ties: the greatest box); NULL without boxes."""
    best = F.array_max(F.transform(_c(boxes), lambda b: F.struct(box_area(b).alias("area"), b.alias("box"))))
    return best["box"]


def detections_kept(detections: Column | str, label: str = "person", score: float = 0.5) -> Column:
    """Of structs (label, score, box): those of one label above a score."""
    return F.filter(_c(detections), lambda d: (d["label"] == label) & (d["score"] > score))


def largest_fraction(detections: Column | str, width: Column | str, height: Column | str) -> Column:
    """Share of the frame that the largest detection covers, 0 without one."""
    areas = F.transform(_c(detections), lambda d: box_area(d["box"]))
    return F.coalesce(F.try_divide(F.array_max(areas), _c(width) * _c(height)), F.lit(0.0))


def letterbox(width: Column | str, height: Column | str, to_width: int = 768, to_height: int = 1024) -> dict[str, Column]:
    """Aspect-preserving fit of a frame into a canvas: scale, size, offsets. Sizes round half to even; NULL for sizes of 0 or less."""
    w, h = _c(width).cast("double"), _c(height).cast("double")
    ok = (w > 0) & (h > 0)
    scale = F.when(ok, F.least(to_width / w, to_height / h))
    new_w = F.greatest(F.lit(1), F.bround(w * scale)).cast("int")
    new_h = F.greatest(F.lit(1), F.bround(h * scale)).cast("int")
    new_w, new_h = F.when(ok, new_w), F.when(ok, new_h)
    return {"scale": scale, "new_width": new_w, "new_height": new_h, "left": F.floor((to_width - new_w) / 2).cast("int"), "top": F.floor((to_height - new_h) / 2).cast("int")}


def pixel_normalise(p: Column | str) -> Column:
    """0..255 to -1..1."""
    return _c(p).cast("double") / 127.5 - 1.0


def aspect(width: Column | str, height: Column | str) -> Column:
    return F.when(_c(height) > 0, _c(width) / _c(height))
