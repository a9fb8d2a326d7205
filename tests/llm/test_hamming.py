import random

import numpy as np
import pytest

from weftline.llm import hamming
from weftline.llm.near_images import band_keys, fast_similarity_sketch, found_overlaps, hash_overlaps, near_hash_links, near_image_groups, overlap_report, sketch_hashes


def planted(n, seed, spread=6):
    rnd = np.random.default_rng(seed)
    h = rnd.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, n, dtype=np.uint64)
    near = h[rnd.integers(0, n, n)].copy()
    for i in range(n):
        for b in rnd.choice(64, rnd.integers(0, spread + 1), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    return np.unique(np.concatenate([h, near]))


def brute(h, d):
    p, q = np.nonzero(np.bitwise_count(h[:, None] ^ h[None, :]) <= d)
    return {(a, b) for a, b in zip(p.tolist(), q.tolist()) if a < b}


def ball(n, seed):
    """Hashes around one, each a few bits away."""
    rnd = np.random.default_rng(seed)
    h = np.full(n, 0x123456789ABCDEF0, np.uint64)
    for k in range(4):
        h ^= np.uint64(1) << rnd.integers(0, 64, n).astype(np.uint64)
    return np.unique(h)


@pytest.mark.parametrize("kind", ["spread", "few bits", "ball"])
@pytest.mark.parametrize("small", [8192, 300])
def test_local_pairs(monkeypatch, kind, small):
    monkeypatch.setattr(hamming, "_SMALL", small)
    monkeypatch.setattr(hamming, "_BLOCK", 100)
    h = planted(900, 1) if kind == "spread" else np.unique(planted(900, 1) & np.uint64(0x3FFFFF)) if kind == "few bits" else ball(1200, 3)
    got = [(min(a, b), max(a, b)) for p, q in hamming.near_pairs(h, 5) for a, b in zip(p.tolist(), q.tolist())]
    assert len(got) == len(set(got)) and set(got) == brute(h, 5)


def test_forest():
    f = hamming.Forest(6)
    f.add(np.array([5, 1]), np.array([4, 2]))
    f.join()
    f.add(np.array([4]), np.array([2]))
    assert [x.tolist() for x in f.stars()] == [[2, 4, 5], [1, 1, 1]]


def test_sketch_fills_every_coordinate():
    assert (fast_similarity_sketch(np.array([7]), 50) == 0).all()
    assert (fast_similarity_sketch(np.arange(9), 64) >= 0).all()
    assert (fast_similarity_sketch(np.array([], np.uint64), 4) == -1).all()


def test_sketches_of_many_hashes_are_those_of_one():
    h = planted(20, 5)
    many = sketch_hashes(h, 48, 3)
    for x, won in zip(h.tolist(), many):
        elements = np.array([2 * p + (x >> p & 1) for p in range(64)])
        assert (elements[fast_similarity_sketch(elements, 48, 3)] == won).all()


def test_recall_of_the_bands():
    rnd = np.random.default_rng(8)
    a = rnd.integers(0, 2**64, 20_000, dtype=np.uint64)
    b = a.copy()
    for p in np.argpartition(rnd.random((len(a), 64)), 5, axis=1)[:, :5].astype(np.uint64).T:
        b ^= np.uint64(1) << p
    assert (np.bitwise_count(a ^ b) == 5).all()
    assert (band_keys(a) == band_keys(b)).any(1).mean() >= 0.9999


def test_chunks_hold_whole_buckets():
    key = np.sort(np.random.default_rng(1).zipf(1.5, 5000) % 300)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(key[s : s + 70]), pa.array(np.arange(s, min(s + 70, 5000)))], ["key", "h"]) for s in range(0, 5000, 70)]
    chunks = list(hamming.bucket_chunks(iter(batches), 100))
    assert np.concatenate([c[1] for c in chunks]).tolist() == list(range(5000))
    seen = [set(c[0].tolist()) for c in chunks]
    assert sum(map(len, seen)) == len(set(key.tolist()))
    largest = np.unique(key, return_counts=True)[1].max()
    assert max(len(c[0]) for c in chunks) <= 2 * (100 + largest) + 70


@pytest.mark.parametrize("full", [2, 10, 40])
def test_copies_of_a_hot_bucket_are_as_many_however_full(spark, full):
    """Rows of one bucket, ``full`` limits full, get the same bounded number of copies."""
    from pyspark.sql import functions as F

    h = np.random.default_rng(full).integers(0, 2**62, 100 * full)
    df = spark.createDataFrame([(1, int(x), 0, -1) for x in h], "key long, h long, path int, place int")
    natural = F.array(*[F.lit(i) for i in range(8)])
    got = hamming.refine_hot(df, natural, 5, len(h), 100)
    assert 6 * len(h) == got.count() and got.groupBy("key").count().agg({"count": "max"}).first()[0] <= 100


def test_sketch_estimates_similarity():
    a, b = np.arange(0, 300), np.arange(100, 400)
    s = np.mean([np.arange(0, 300)[fast_similarity_sketch(a, 64, k)] == np.arange(100, 400)[fast_similarity_sketch(b, 64, k)] for k in range(8)])
    assert abs(s - 0.5) < 0.1


@pytest.mark.parametrize("hot", [10**6, 40])
def test_links_have_the_components_of_all_pairs(spark, hot):
    h = planted(300, 2)
    h[:120] = (h[:120] & np.uint64(0xFFFFFF)) | np.uint64(7 << 40)
    h = np.unique(h)
    df = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "x long")
    links = [(r["a"], r["b"]) for r in near_hash_links(df, "x", 5, hot).collect()]
    from tests.llm.test_components import brute as components

    v = h.view(np.int64).tolist()
    want = components([(v[a], v[b]) for a, b in brute(h, 5)])
    assert components(links) == want


@pytest.mark.parametrize("hot", [10**6, 30])
def test_overlaps_are_exactly_all_pairs(spark, hot):
    h = planted(250, 3)
    side = np.random.default_rng(0).random(len(h)) < 0.3
    h[:100] |= np.uint64(0xFF)  # a shingle that many share
    rows = sorted({(int(x), bool(s)) for x, s in zip(h.view(np.int64), side)} | {(5, True), (5, False)})
    df = spark.createDataFrame(rows, "h long, side boolean")
    got = [tuple(r) for r in hash_overlaps(df, 5, hot_rows=hot).collect()]
    ev, tr = [x for x, s in rows if s], [x for x, s in rows if not s]
    want = {(a, b) for a in ev for b in tr if bin((a ^ b) & (2**64 - 1)).count("1") <= 5}
    assert len(got) == len(set(got)) and set(got) == want


SCHEMA = "image_id string, sku_id string, phash long, split string, read_ok boolean, branch string"


def test_frames_of_tables(spark):
    rows = [
        ("a", "s", 1, "train", True, "product"), ("a", "s", None, None, None, "product"),  # hash from one row
        ("b", "s", 3, " VAL ", True, "review"), ("c", "s", -1, "test", True, "review"), ("d", "s", -1, "train", True, None),
        ("e", "s", 1, "train", False, "product"), ("f", "s", 1, None, True, "product"), (None, "s", 1, "train", True, "product"), ("g", "s", None, "test", None, "review"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as h", "2 as n", "3 as first")
    assert sorted(map(tuple, found_overlaps(df).collect())) == [("a", "b"), ("c", "d")]
    assert {tuple(r) for r in near_image_groups(df).collect()} == {("a", "a"), ("b", "a"), ("f", "a"), ("c", "c"), ("d", "c")}
    assert {tuple(r) for r in overlap_report(df).collect()} == {("val", "review", 1, 1), ("test", "review", 1, 1)}
    none = df.limit(0)
    assert found_overlaps(none).count() == near_image_groups(none).count() == overlap_report(none).count() == 0


def test_hot_hash(spark):
    rows = [(f"{i:04}", "s", 9, "train" if i % 100 else "test", True, "product") for i in range(600)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found_overlaps(df).count() == 6 * 594
    assert {r["group_id"] for r in near_image_groups(df).collect()} == {"0000"}
