"""Test items inside corpus documents, by greedy string tiling on shared word runs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bloom import MOST_BYTES, BloomFilter, bloom_filter
from weftline.llm.words import WordHashes, portions, windows_at, words
from weftline.plans.bounded import small_side
from weftline.plans.durable import materialize

#: Base of the second hash of a window, which confirms a seed.
CONFIRM = 0xC2B2AE3D27D4EB4F

_OUT = "doc_id long, item_id long, tiles int, longest int, covered int, item_words int, coverage double"


def tile(at: np.ndarray, to: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc place, item place, length) of the longest non-overlapping matches of ``least`` words or more.

    ``at``, ``to``: places in doc and item of seeds, windows of ``least`` equal words. Seeds in
    a row make maximal matches; the longest match is marked first, and what later matches have left
    between marks is used if still long enough. Ties go to the earlier place.
    """
    if not len(at):
        return []
    order = np.lexsort((at, at - to))
    at, to = at[order], to[order]
    new = np.flatnonzero(np.r_[True, (np.diff(at - to) != 0) | (np.diff(at) != 1)])
    end = np.r_[new[1:], len(at)]
    heap = [(-(int(at[e - 1] - at[s]) + least), int(at[s]), int(to[s])) for s, e in zip(new, end)]
    heapq.heapify(heap)
    # Marks only where seeds are: places are counted from the first one.
    d0, i0 = int(at.min()), int(to.min())
    dm, im = np.zeros(int(at.max()) - d0 + least, bool), np.zeros(int(to.max()) - i0 + least, bool)
    tiles = []
    while heap:
        n, d, i = heapq.heappop(heap)
        n = -n
        taken = dm[d - d0 : d - d0 + n] | im[i - i0 : i - i0 + n]
        if not taken.any():
            dm[d - d0 : d - d0 + n] = im[i - i0 : i - i0 + n] = True
            tiles.append((d, i, n))
            continue
        edge = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for s, e in zip(edge[::2], edge[1::2]):  # runs without marks
            if e - s >= least:
                heapq.heappush(heap, (-int(e - s), d + int(s), i + int(s)))
    return tiles


def _seeds(least: int, wanted: BloomFilter | None = None):
    """Windows of ``least`` words of each text, of ``wanted`` ones only: id, a hash of the text, its words, place, seed and confirming hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows in portions(it, 1):
            of, size = [], []
            for _, t in rows:
                of.append(hashes.of(words(t)))
                size.append(len(of[-1]))
            h, n = np.concatenate(of), np.array(size)
            start = np.cumsum(n) - n
            row = np.repeat(np.arange(len(rows)), n)
            at = np.flatnonzero(np.arange(len(h)) + least <= (start + n)[row])  # windows inside one text
            seed = windows_at(h, at, least)
            if wanted is not None:
                hit = wanted.passes(seed)
                at, seed = at[hit], seed[hit]
            confirm, row = windows_at(h, at, least, CONFIRM), row[at]
            own = {r: xxhash.xxh3_64_intdigest(rows[r][1]) for r in np.unique(row).tolist()}
            cols = [pa.array(np.array([x[0] for x in rows], np.int64)[row]), pa.array(np.array([own[r] for r in row.tolist()], np.uint64).view(np.int64)), pa.array(n[row].astype(np.int32)), pa.array((at - start[row]).astype(np.int32)), pa.array(seed.view(np.int64)), pa.array(confirm.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "own", "words", "at", "seed", "confirm"])

    return run


_SEEDS = "id long, own long, words int, at int, seed long, confirm long"


def _tiled(least: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for d, i, n, at, to in zip(*[c.to_pylist() for c in b.columns]):
                tiles = tile(np.array(at), np.array(to), least)
                covered = sum(t[2] for t in tiles)
                out.append((d, i, len(tiles), max(t[2] for t in tiles), covered, n, covered / n))
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "tiles", "longest", "covered", "item_words", "coverage"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, least: int = 12, filter_bytes: int = MOST_BYTES) -> DataFrame:
    """Every (document, test item) that share ``least`` words in a row or more, with the tiles they share.

    Columns ``doc_id``, ``item_id``, ``tiles``, ``longest``, ``covered`` (words of the item inside tiles),
    ``item_words``, ``coverage``. Tiles may stand in another order than in the item, so
    ``coverage`` also measures reordered passages.

    The seeds of the items (Karp-Rabin hashes of ``least`` words in a row) are a table, and a Bloom filter of them of at most
    ``filter_bytes`` goes to the workers. Documents are read once and only their seeds that pass leave a worker, with
    their places and a second, independent hash; those that an item has too (both hashes, 128 bits, stand for the words) are
    grouped by pair and tiled. What is shuffled follows the leaked text, not the corpus; with more item seeds than the filter has
    room for, more passes, and the rows stay the same. A seed that many items and many documents share is joined with adaptive skew
    splitting; each such pair is a result.

    NULL and empty texts, and texts under ``least`` words, match nothing; NULL ids are dropped;
    repeated rows give no repeated results, and of several texts with one id the best covered counts. Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    test = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    known = materialize(test.mapInArrow(_seeds(least), _SEEDS), "seeds")
    wanted = bloom_filter(known, "seed", filter_bytes)
    found = docs.mapInArrow(_seeds(least, wanted), _SEEDS).select(F.col("id").alias("doc_id"), F.col("own").alias("doc_own"), "at", "seed", "confirm")
    have = small_side(known.select(F.col("id").alias("item_id"), F.col("own").alias("item_own"), F.col("words").alias("n"), F.col("at").alias("to"), F.col("seed").alias("s"), F.col("confirm").alias("c")))
    met = found.join(have, (F.col("seed") == F.col("s")) & (F.col("confirm") == F.col("c")))
    pairs = met.groupBy("doc_id", "doc_own", "item_id", "item_own", "n").agg(F.collect_set(F.struct("at", "to")).alias("x"))
    tiled = pairs.select("doc_id", "item_id", "n", "x.at", "x.to").mapInArrow(_tiled(least), _OUT)
    best = tiled.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "longest", "tiles", "item_words", "coverage")).alias("m"))
    return best.select("doc_id", "item_id", "m.tiles", "m.longest", "m.covered", "m.item_words", "m.coverage")


def leak_report(documents: DataFrame, items: DataFrame, whole: float = 0.5, **kw) -> DataFrame:
    """Per test item: documents that hold a passage of it, documents that hold at least ``whole`` of it, and the greatest coverage."""
    m = leaked_items(documents, items, **kw)
    return m.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("coverage") >= whole).cast("long")).alias("mostly"), F.round(F.max("coverage"), 6).alias("most"))
