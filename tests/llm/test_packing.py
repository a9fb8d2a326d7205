import random
from collections import Counter, defaultdict

import pytest

from weftline.llm.packing import encoder, VOCABULARY, pack_documents, pack_histogram, packing_report, placements


def loads(patterns):
    return [sum(p) for n, p in patterns for _ in range(n)]


@pytest.mark.parametrize("seed", range(25))
def test_patterns_use_every_length_and_never_overflow(seed):
    rnd = random.Random(seed)
    h = {rnd.randint(1, 50): rnd.randint(1, 40) for _ in range(rnd.randint(0, 12))}
    p = pack_histogram(h, 50)
    used = Counter()
    for n, lengths in p:
        for x in lengths:
            used[x] += n
    assert dict(used) == h and max(loads(p), default=0) <= 50
    # No better than the bound, no worse than a pack more than half full each.
    total = sum(x * n for x, n in h.items())
    assert -(-total // 50) <= len(loads(p)) <= max(1, 2 * total // 50 + 1) or not h


def test_short_texts_leave_little_room():
    rnd = random.Random(0)
    h = Counter(min(2048, int(rnd.expovariate(1 / 150)) + 5) for _ in range(20_000))
    p = pack_histogram(h, 2048)
    assert 1 - sum(x * n for x, n in h.items()) / (2048 * len(loads(p))) < 0.005


def test_wrong_lengths_and_empty():
    assert pack_histogram({}, 10) == [] and placements([]).shape == (0, 4)
    with pytest.raises(ValueError):
        pack_histogram({11: 1}, 10)


def test_documents(spark):
    texts = [None, "", "слово " * 700, "a b c", "a b c"] + [f"text number {i} " * (i % 9 + 1) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as id", "2 as rank", "3 as part")
    rows = pack_documents(df, capacity=64).collect()
    enc = encoder(VOCABULARY)
    by, room = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        if r["n_tokens"]:
            room[r["sequence_id"]].append((r["sequence_offset"], r["n_tokens"]))
    assert set(by) == set(range(len(texts)))
    for i, t in enumerate(texts):
        n = len(enc.encode_ordinary(t)) if t else 0
        parts = sorted(by[i], key=lambda r: r["part"])
        assert sum(r["n_tokens"] for r in parts) == n and [r["start"] for r in parts] == [64 * k for k in range(len(parts))]
        assert len(parts) == max(1, -(-n // 64))
    for spans in room.values():
        spans.sort()
        assert spans[-1][0] + spans[-1][1] <= 64 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    assert set(room) == set(range(len(room)))
    assert {tuple(r) for r in pack_documents(df, capacity=64).collect()} == {tuple(r) for r in rows}
    assert packing_report(pack_documents(df, capacity=64), 64).first()["fullest"] <= 64
    assert pack_documents(df.limit(0), capacity=64).count() == 0
