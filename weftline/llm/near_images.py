"""Near-equal frames by perceptual hash: groups, and overlaps across splits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.hamming import BUCKET_ROWS, SHINGLES, Forest, bucket_chunks, bucket_pairs, by_bucket, deeper, refine_hot, shingle
from weftline.operators.graph import connected_components
from weftline.plans.durable import materialize, release


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _placed(e: np.ndarray, t: int, i: int, seed: int) -> tuple[list[int], np.ndarray]:
    """Bin and value of each element in round ``i`` of a sketch with ``t`` coordinates."""
    with np.errstate(over="ignore"):
        r = _mix(e * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + i + 1) * np.uint64(0xD1B54A32D192ED03))
    bins = (r >> np.uint64(40)) % np.uint64(t) if i < t else np.full(len(e), i - t, np.uint64)
    return bins.astype(int).tolist(), i + (r & np.uint64(0xFFFFFF)) / float(1 << 24)


def fast_similarity_sketch(elements: np.ndarray, coordinates: int, seed: int = 0) -> np.ndarray:
    """Index of the element that wins each coordinate of a fast similarity sketch.

    Rounds of hashed bin placement: in round i < t every element goes to a random
    bin with the value i plus a random fraction, in round i >= t to bin i - t.
    A coordinate keeps its smallest value. Rounds stop as soon as all coordinates are filled,
    which the last t rounds guarantee. No element gives an empty sketch.
    """
    e = np.unique(np.asarray(elements, np.uint64))
    t = coordinates
    won, value = np.full(t, -1), np.full(t, np.inf)
    if not len(e):
        return won
    for i in range(2 * t):
        bins, v = _placed(e, t, i, seed)
        for k in np.argsort(v, kind="stable"):
            b = bins[k]
            if v[k] < value[b]:
                won[b], value[b] = k, v[k]
        if (won >= 0).all():
            break
    return won


#: Bands of a sketch and coordinates in each. At 5 differing bits of 64 (Jaccard similarity 59/69 = 0.855) a pair shares no band once in about a million.
BANDS, WIDTH = 24, 6


@lru_cache
def _ways(coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements that each coordinate prefers, best first: their positions and bits, as arrays (step, coordinate).

    The elements of a hash are the 64 (position, bit) pairs it has out of 128. The same rounds of bin placement as in
    ``fast_similarity_sketch`` are run over all 128, keeping every element that reaches a coordinate in order of
    its value; a list may end once it has both elements of a position, as each hash has one of them.
    """
    e = np.arange(128, dtype=np.uint64)
    lists: list[list[int]] = [[] for _ in range(coordinates)]
    for i in range(2 * coordinates):
        open_ = [not any(x ^ 1 in way for x in way) for way in lists]
        if not any(open_):
            break
        bins, value = _placed(e, coordinates, i, seed)
        for k in np.argsort(value, kind="stable").tolist():
            way = lists[bins[k]]
            if open_[bins[k]] and k not in way:
                way.append(k)
    steps = max(map(len, lists))
    at = np.array([way + way[-1:] * (steps - len(way)) for way in lists], np.uint64).T
    return at >> np.uint64(1), at & np.uint64(1)


def sketch_hashes(h: np.ndarray, coordinates: int = BANDS * WIDTH, seed: int = 1) -> np.ndarray:
    """Fast similarity sketches of many hashes at once: per hash and coordinate the winning element, 2 * position + bit."""
    position, bit = _ways(coordinates, seed)
    won = np.empty((len(h), coordinates), np.uint8)
    flat = won.reshape(-1)
    rest = np.arange(won.size)
    row, col = np.repeat(np.arange(len(h)), coordinates), np.tile(np.arange(coordinates), len(h))
    for p, b in zip(position, bit):
        at, has = p[col], b[col]
        flat[rest] = (2 * at + has).astype(np.uint8)
        miss = (h[row] >> at & np.uint64(1)) != has
        rest, row, col = rest[miss], row[miss], col[miss]
        if not len(rest):
            break
    return won


def band_keys(h: np.ndarray, bands: int = BANDS, width: int = WIDTH, seed: int = 1) -> np.ndarray:
    """The bands of each hash's sketch as numbers (hash, band): band number and its coordinates' winners."""
    won = sketch_hashes(h, bands * width, seed).reshape(len(h), bands, width).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), won.shape[:2])
    with np.errstate(over="ignore"):
        for i in range(width):
            key = key * np.uint64(128) + won[:, :, i]
        return _mix(key)


def _banded(bands: int, width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            h = b.column(0).to_numpy()
            for s in range(0, len(h), 4096):
                part = h[s : s + 4096]
                keys = band_keys(part.view(np.uint64), bands, width)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part, bands))], ["key", "h"])

    return run


def _stars(d: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, h in bucket_chunks(it):
            h = h.view(np.uint64)
            joined = Forest(len(h))
            for p, q in bucket_pairs(key, h, d):
                joined.add(p, q)
            at, low = joined.stars()
            link = np.unique(np.stack([h[at], h[low]], 1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(link[:, 0]), pa.array(link[:, 1])], ["a", "b"])

    return run


def near_hash_links(hashes: DataFrame, h: str, max_bits: int = 5, hot_rows: int = BUCKET_ROWS, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of the pairs of hashes within ``max_bits`` bits.

    ``hashes`` must hold each hash once. Every hash is sketched (fast similarity sketching of its 64 (position, bit)
    elements), hashes that share a band of their sketches meet in a bucket, all 64 bits verify
    each candidate, and each bucket returns a spanning star per local group instead of all its pairs. A hash has
    ``bands`` copies; in buckets of more than ``hot_rows`` hashes a fixed number more
    (``refine_hot``), which loses no near pair of the bucket. NULL hashes are ignored.
    """
    one = hashes.filter(F.col(h).isNotNull()).select(F.col(h).cast("long").alias("h"))
    rows = one.mapInArrow(_banded(bands, width), "key long, h long")
    rows = rows.withColumns({"path": F.lit(0), "place": F.lit(-1)})
    natural = F.array(*[F.lit(i) for i in range(SHINGLES)])
    placed = refine_hot(rows, natural, max_bits, one.count(), hot_rows)
    return by_bucket(placed, "h").mapInArrow(_stars(max_bits), "a long, b long")


def _frames(images: DataFrame, with_split: bool, with_branch: bool = False) -> DataFrame:
    """One row per image that counts: ``image_id``, ``h`` (and ``split``, ``branch``), from whichever of its rows has them."""
    split = F.lower(F.trim(F.col("split")))
    split = [F.max(F.when(split.isin("train", "val", "test"), split)).alias("split")] if with_split else []
    split += [F.min("branch").alias("branch")] if with_branch else []
    one = images.groupBy("image_id").agg(F.max("phash").alias("h"), F.max(F.when(F.col("read_ok") == F.lit(False), 1)).alias("bad"), *split)
    return one.filter("image_id is not null and h is not null and bad is null" + " and split is not null" * with_split).drop("bad")


def near_image_groups(images: DataFrame, max_bits: int = 5, hot_rows: int = BUCKET_ROWS) -> DataFrame:
    """``image_id``, ``group_id`` of every frame that has a near-equal partner.

    Frames whose ``phash`` differ in at most ``max_bits`` bits are in one group, and
    so are frames joined through others; ``group_id`` is the smallest
    ``image_id`` of the group. A frame has the hash that any of its rows has;
    unreadable frames, NULL hashes and NULL ids never count; repeated rows count once. Frames with
    the very same hash are one vertex of the link graph, so a hash shared by
    a third of all frames costs one row. Candidates come from sketches: a pair of hashes at 5 bits that nothing else
    joins is missed about once in a million (less at fewer bits). An empty table gives no rows.
    """
    frames = materialize(_frames(images, False), "frames")
    hashes = materialize(frames.groupBy("h").agg(F.min("image_id").alias("first"), F.count(F.lit(1)).alias("n")), "hashes")
    links = materialize(near_hash_links(hashes, "h", max_bits, hot_rows), "links")
    labels = materialize(connected_components(links, "a", "b"), "labels")
    release(links)
    near = hashes.join(labels, F.col("h") == F.col("vertex")).select("h", "first", "component")
    smallest = near.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("group_id"))
    groups = near.join(smallest, F.col("component") == F.col("c")).select("h", "group_id")
    alone = hashes.filter("n > 1").join(labels, F.col("h") == F.col("vertex"), "left_anti").select("h", F.col("first").alias("group_id"))
    groups = groups.unionByName(alone).withColumnRenamed("h", "gh")
    return frames.join(groups, F.col("h") == F.col("gh")).select("image_id", "group_id")


def _overlaps_of(rank: np.ndarray, d: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(SHINGLES, dtype=np.uint64)
        for key, h, side, path in bucket_chunks(it):
            h, side, path = h.view(np.uint64), side.astype(bool), path.astype(np.int64)

            def accept(p, q):
                p_, q_ = p, q
                ok = side[p_] != side[q_]  # noqa: B023
                ok[ok] = first(p_[ok], q_[ok])  # noqa: B023
                return ok

            def first(p, q):
                """Whether the bucket's shingles are the rarest that the two share, so that each pair comes from one bucket."""
                value = (h[p][:, None] >> (at * np.uint64(8)) & np.uint64(255)).astype(np.int64)  # noqa: B023
                differ = (h[p] ^ h[q])[:, None] >> (at * np.uint64(8)) & np.uint64(255)  # noqa: B023
                r = np.where(differ == 0, rank[at.astype(int), value], np.iinfo(np.int64).max)
                place = np.argsort(np.argsort(r, 1, kind="stable"), 1, kind="stable")
                chosen = place < np.bitwise_count(path[p])[:, None]  # noqa: B023
                return ((chosen << np.arange(SHINGLES)).sum(1) == path[p]) & (path[p] == path[q])  # noqa: B023

            for p, q in bucket_pairs(key, h, d, accept):
                if len(p):
                    ev, tr = np.where(side[p], p, q), np.where(side[p], q, p)
                    yield pa.RecordBatch.from_arrays([pa.array(h[ev].view(np.int64)), pa.array(h[tr].view(np.int64))], ["he", "ht"])

    return run


def hash_overlaps(hashes: DataFrame, max_bits: int = 5, hot_rows: int = BUCKET_ROWS) -> DataFrame:
    """All pairs (``he`` of side 1, ``ht`` of side 0) of hashes within ``max_bits`` bits, once each.

    ``hashes``: distinct rows ``h`` long, ``side`` boolean (true: evaluation). A hash is the set of its
    8 runs of 8 bits with their places (shingles); hashes within ``max_bits`` bits
    share at least t = 8 - ``max_bits`` of them. Shingles are ordered by how rare they
    are over all data (a table of 2,048 counts), and the n-th rarest shared shingle of two
    sets stands within the 8 - t + n rarest of each: a hash is indexed and probed under its
    8 - t + 1 rarest only (position filter). In buckets of more than ``hot_rows`` hashes the second and
    third rarest shared shingle are joined on too, at 21 and 56 copies of a hash at most.
    All sets have the same size, so the length filter passes every pair. The full hashes verify each candidate, and
    the bucket of the rarest shared shingles reports the pair.
    """
    if not 0 <= max_bits <= SHINGLES - 2:
        raise ValueError("two hashes must share at least two shingles")
    parts = F.array(*[shingle(i) for i in range(SHINGLES)])
    counts = hashes.select(F.posexplode(parts).alias("at", "value")).groupBy("at", "value").count()
    rows = counts.orderBy("count", "at", "value").collect()  # at most 8 * 256
    rank = np.full((SHINGLES, 256), len(rows), np.int64)
    for r, row in enumerate(rows):
        rank[row["at"], row["value"]] = r
    table = F.array(*[F.element_at(F.array(*[F.lit(int(x)) for x in rank[i]]), shingle(i) + 1) for i in range(SHINGLES)])
    ordered = F.transform(F.array_sort(F.arrays_zip(table.alias("r"), F.array(*[F.lit(i) for i in range(SHINGLES)]).alias("i"))), lambda x: x["i"])
    start = hashes.select("h", F.col("side").cast("int").alias("side"), ordered.alias("order"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("path"), F.lit(-1).alias("place"))
    placed = refine_hot(deeper(start, F.col("order"), max_bits), F.col("order"), max_bits, hashes.count(), hot_rows)
    return by_bucket(placed, "h", "side", "path").mapInArrow(_overlaps_of(rank, max_bits), "he long, ht long")


def _sided(images: DataFrame, branch: bool = False) -> tuple[DataFrame, DataFrame]:
    """(frames with ``h`` and ``split``, their distinct hashes with ``side``), written."""
    frames = materialize(_frames(images, True, branch), "frames")
    return frames, materialize(frames.select("h", (F.col("split") != "train").alias("side")).distinct(), "sides")


def split_overlaps(images: DataFrame, max_bits: int = 5, hot_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs of a val or test frame with an (almost) equal train frame: ``eval_id``, ``train_id``, ``eval_split``.

    A frame has the hash and the split that any of its rows has; unreadable
    frames and frames without hash, split or id never count. Split labels are
    compared without case and outer blanks. Every pair of different frames comes once; pairs are
    found between distinct hashes first and only then expanded to frames.
    """
    frames, hashes = _sided(images)
    pairs = hash_overlaps(hashes, max_bits, hot_rows=hot_rows)
    ev = frames.filter("split <> 'train'").select(F.col("image_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("h").alias("eh"))
    tr = frames.filter("split = 'train'").select(F.col("image_id").alias("train_id"), F.col("h").alias("th"))
    return pairs.join(ev, F.col("he") == F.col("eh")).join(tr, F.col("ht") == F.col("th")).select("eval_id", "train_id", "eval_split")


def found_overlaps(images: DataFrame, **kw) -> DataFrame:
    """``image_a``, ``image_b`` of ``split_overlaps``, the smaller id first."""
    return split_overlaps(images, **kw).select(F.least("eval_id", "train_id").alias("image_a"), F.greatest("eval_id", "train_id").alias("image_b"))


def overlap_report(images: DataFrame, max_bits: int = 5, hot_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs and frames concerned per evaluation split and ``branch`` of the evaluation frame.

    Pairs are counted on distinct hashes (train frames per hash), never expanded.
    A frame whose rows name several branches counts under the smallest; without one, under NULL.
    """
    frames, hashes = _sided(images, True)
    train = frames.filter("split = 'train'").groupBy(F.col("h").alias("th")).agg(F.count(F.lit(1)).alias("n"))
    met = hash_overlaps(hashes, max_bits, hot_rows).join(train, F.col("ht") == F.col("th")).groupBy("he").agg(F.sum("n").alias("n"))
    ev = frames.filter("split <> 'train'").groupBy(F.col("split").alias("eval_split"), "branch", "h").agg(F.count(F.lit(1)).alias("frames"))
    per = ev.join(met, F.col("h") == F.col("he"))
    return per.groupBy("eval_split", "branch").agg(F.sum(F.col("n") * F.col("frames")).alias("pairs"), F.sum("frames").alias("eval_frames"))
