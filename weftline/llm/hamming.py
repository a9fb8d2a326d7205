"""Pairs of 64-bit hashes that differ in few bits: exact, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.bounded import small_side
from weftline.plans.durable import materialize, release

#: Rows of one bucket that a task may hold; fuller buckets are refined (exactly) before the shuffle.
BUCKET_ROWS = 1_000_000
#: Rows of whole buckets that a task handles at a time.
CHUNK_ROWS = 100_000
#: Runs up to _DENSE rows are compared by offsets, row sets up to _SMALL in blocks of _BLOCK; up to _MIDDLE one shared band makes a candidate, beyond it two.
_DENSE, _SMALL, _MIDDLE, _BLOCK = 256, 512, 1 << 16, 1024

Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def split_bits(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of the given bit positions, sizes as even as possible."""
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cut, cut[1:])]


def _first(x: np.ndarray, masks: np.ndarray, at: tuple[int, ...]) -> np.ndarray:
    """Whether ``masks[at]`` are the first masks on which the difference ``x`` is empty."""
    ok = np.ones(len(x), bool)
    for k in range(at[-1]):
        if k not in at:
            ok &= (x & masks[k]) != 0
    return ok


def _run_pairs(key: np.ndarray, h: np.ndarray, d: int, row: np.ndarray, bits: list[int], accept) -> Pairs:
    """Pairs of rows with equal (sorted) ``key`` whose hashes differ in at most ``d`` bits; ``bits`` are those that may differ inside a run."""
    n = len(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, int)
    length = np.diff(np.r_[start, n])
    short = length <= _DENSE
    alive = np.flatnonzero(np.repeat(short & (length > 1), length))
    end, off = np.repeat(start + length, length), 1
    while len(alive):
        alive = alive[alive + off < end[alive]]
        hit = alive[np.bitwise_count(h[alive] ^ h[alive + off]) <= d]
        if len(hit):
            p, q = row[hit], row[hit + off]
            keep = accept(p, q)
            yield p[keep], q[keep]
        off += 1
    for lo, size in zip(start[~short], length[~short]):
        rows = row[lo : lo + size]
        for p, q in near_pairs(h[lo : lo + size], d, lambda p, q: accept(rows[p], rows[q]), bits):  # noqa: B023
            yield rows[p], rows[q]


def _all_pairs(h: np.ndarray, d: int, accept) -> Pairs:
    """Pairs found block by block; only those within ``d`` bits leave a block."""
    for s in range(0, len(h), _BLOCK):
        for t in range(s, len(h), _BLOCK):
            p, q = np.nonzero(np.bitwise_count(h[s : s + _BLOCK, None] ^ h[None, t : t + _BLOCK]) <= d)
            p, q = s + p, t + q
            keep = p < q
            p, q = p[keep], q[keep]
            keep = accept(p, q)
            yield p[keep], q[keep]


def near_pairs(h: np.ndarray, d: int, accept=None, bits: list[int] | None = None) -> Pairs:
    """All pairs of rows (by index) whose hashes differ in at most ``d`` bits, in chunks.

    Only bits that vary among the rows matter. They are cut into ``d + m`` bands: two hashes within
    ``d`` bits agree on at least ``m`` (1 for middling row sets, 2 for large ones), so only rows that
    share as many bands are compared; crowded buckets are cut again over their remaining bits. Rows so
    much alike that most share a bucket are compared block by block (their pairs are then nearly all
    results). Each pair comes once. ``accept(p, q)`` may restrict the pairs (a mask over row arrays).
    """
    accept = accept or (lambda p, q: np.ones(len(p), bool))
    n = len(h)
    if n < 2:
        return
    vary = int(np.bitwise_or.reduce(h ^ h[0]))
    bits = [x for x in (range(64) if bits is None else bits) if vary >> x & 1]
    if n <= _SMALL or len(bits) < 2 * (d + 2):
        yield from _all_pairs(h, d, accept)
        return
    m = 1 if n <= _MIDDLE else 2
    masks = np.array(split_bits(bits, d + m), np.uint64)
    if n <= _MIDDLE and 2 * max(int(np.unique(h & x, return_counts=True)[1].max()) for x in masks) > n:
        yield from _all_pairs(h, d, accept)
        return
    for at in combinations(range(d + m), m):
        both = np.bitwise_or.reduce(masks[list(at)])
        order = np.argsort(h & both, kind="stable")
        hs = h[order]
        rest = [x for x in bits if not int(both) >> x & 1]
        yield from _run_pairs(hs & both, hs, d, order, rest, lambda p, q: accept(p, q) & _first(h[p] ^ h[q], masks, at))  # noqa: B023


def bucket_pairs(key: np.ndarray, h: np.ndarray, d: int, accept=None) -> Pairs:
    """Pairs of rows in one bucket (equal, sorted ``key``) whose hashes differ in at most ``d`` bits."""
    accept = accept or (lambda p, q: np.ones(len(p), bool))
    yield from _run_pairs(key, h, d, np.arange(len(key)), list(range(64)), accept)


class Forest:
    """Groups of rows that links join, each named by its smallest row. Links come in chunks and aren't kept."""

    def __init__(self, n: int):
        self.low = np.arange(n)
        self.buffer: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        self.buffer.append((p, q))
        self.held += len(p)
        if self.held > 1_000_000:
            self.join()

    def join(self) -> None:
        if not self.held:
            return
        p, q = (np.concatenate(x) for x in zip(*self.buffer))
        self.buffer, self.held, low = [], 0, self.low
        while True:
            a, b = low[p], low[q]
            apart = a != b
            if not apart.any():
                return
            p, q = a[apart], b[apart]
            np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
            while not np.array_equal(low[low], low):
                low[:] = low[low]

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, smallest row of its group) of every row that isn't the smallest itself."""
        self.join()
        at = np.flatnonzero(self.low != np.arange(len(self.low)))
        return at, self.low[at]


#: Shingles of a hash: its runs of 8 bits with their places.
SHINGLES = 8


def shingle(i: int) -> F.Column:
    """Content of the ``i``-th shingle of ``h``."""
    return F.shiftrightunsigned("h", 8 * i).bitwiseAND(F.lit(255)).cast("int")


def deeper(rows: DataFrame, order: F.Column, d: int) -> DataFrame:
    """Each row under every shingle that may be the next one it shares with a near hash: new ``key``, ``path``, ``place``.

    ``rows``: ``key``, ``h``, ``path`` (bit mask of the shingles used so far), ``place`` (in ``order``, an array of
    shingle numbers, of the last one used; -1 before). Hashes within ``d`` bits share
    t = 8 - d shingles or more, so in an order common to both the n-th shared one stands among the first
    8 - t + n: no near pair is lost, and a row has at most 6, 21 or 56 copies at depth 1, 2 or 3 (d = 5).
    """
    n = F.expr("cast(bit_count(path) as int)")
    places = F.sequence(F.col("place") + 1, F.lit(d) + n)  # 0-based: 8 - t + n + 1 - 1
    spread = rows.withColumn("place", F.explode(places)).withColumn("__i", F.element_at(order, F.col("place") + 1))
    content = F.element_at(F.array(*[shingle(i) for i in range(SHINGLES)]), F.col("__i") + 1)
    spread = spread.withColumn("key", F.xxhash64("key", "__i", content))
    return spread.withColumn("path", F.col("path").bitwiseOR(F.expr("shiftleft(1, __i)"))).drop("__i")


def _hot_keys(rows: DataFrame, n: int, limit: int) -> DataFrame | None:
    """Keys of more than ``limit`` of the ``n`` rows, None without any.

    Rows are first counted in cells of keys, a small table made map-side; keys are counted only inside cells that are full enough.
    """
    cells = 1 << max(12, (8 * n // limit).bit_length())
    cell = F.pmod("key", F.lit(cells)).cast("int")
    full = materialize(rows.groupBy(cell.alias("__cell")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("__cell"), "cells")
    inside = rows.select("key", cell.alias("c")).join(small_side(full), F.col("c") == F.col("__cell"))
    hot = materialize(inside.groupBy(F.col("key").alias("__hot")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("__hot"), "hot")
    release(full)
    return None if hot.isEmpty() else hot


def refine_hot(rows: DataFrame, order: F.Column, d: int, n: int, limit: int = BUCKET_ROWS) -> DataFrame:
    """Rows of buckets with more than ``limit`` rows moved to buckets that share one, two or three more shingles.

    A row of a full bucket gets a fixed number of copies, however full the bucket is. ``n`` is the number of different hashes: a
    bucket holds each at most once, so with ``n`` within the limit none can be too full and none is looked for.
    """
    if n <= limit:
        return rows
    done = None
    depth = F.expr("bit_count(path)")
    while True:
        hot = _hot_keys(rows, n * 64, limit)
        if hot is None:
            return rows if done is None else done.unionByName(rows)
        side = small_side(hot)
        calm = rows.join(side, F.col("key") == F.col("__hot"), "left_anti")
        full = rows.join(side, F.col("key") == F.col("__hot"), "left_semi")
        last = full.filter(depth >= SHINGLES - d)  # they share 24 bits or more: left as they are
        calm = calm.unionByName(last)
        done = calm if done is None else done.unionByName(calm)
        rows = deeper(full.filter(depth < SHINGLES - d), order, d)


def by_bucket(rows: DataFrame, *columns: str) -> DataFrame:
    """``key`` and the given columns, shuffled and sorted so that buckets pass a task one after the other."""
    return rows.select("key", *columns).repartition("key").sortWithinPartitions("key")


def bucket_chunks(it: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[list[np.ndarray]]:
    """The columns (as arrays) of whole buckets, about ``rows`` rows at a time; a task never holds more than that and one bucket."""
    held: list[list[np.ndarray]] = []
    n, least = 0, rows

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*held)]

    for b in it:
        if b.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
        if n < least:
            continue
        cols = joined()
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if cut:
            yield [c[:cut] for c in cols]
        held, n = [[c[cut:].copy() for c in cols]], n - cut
        least = max(rows, 2 * n)
    if n:
        yield joined()
