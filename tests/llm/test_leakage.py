import random

import numpy as np
import pytest

from weftline.llm.bloom import bloom_filter
from weftline.llm.leakage import leak_report, leaked_items, tile
from weftline.llm.words import WordHashes, windows, words


def test_words():
    assert words("Ёлка <b>и</b>&nbsp;два-3!<br/>ЩИ </") == ["елка", "и", "два", "3", "щи"]
    assert words(None) == words("") == words("<br>&amp;") == []


def test_windows_are_equal_exactly_for_equal_runs():
    h = WordHashes().of(list("abcabcab"))
    k = windows(h, 3)
    assert len(k) == 6 and k[0] == k[3] and len(set(k.tolist())) == 3
    assert len(windows(h, 9)) == 0


def tiles(doc, item, least):
    h = WordHashes()
    d, i = h.of(doc), h.of(item)
    seeds = [(x, y) for x, a in enumerate(windows(d, least)) for y, b in enumerate(windows(i, least)) if a == b]
    at, to = (np.array(x, int) for x in zip(*seeds)) if seeds else (np.zeros(0, int), np.zeros(0, int))
    return tile(at, to, least)


def test_tiling_is_greedy_and_never_overlaps():
    assert tiles("xxabcdyy", "abcd", 3) == [(2, 0, 4)]
    assert sorted(tiles("defgabc", "abcdefg", 3)) == [(0, 3, 4), (4, 0, 3)]  # reordered
    rnd = random.Random(4)
    for _ in range(40):
        d, i = ([rnd.choice("ab") for _ in range(rnd.randint(0, 40))] for _ in range(2))
        t = tiles(d, i, 3)
        for k in (0, 1):
            used = [x for m in t for x in range(m[k], m[k] + m[2])]
            assert len(used) == len(set(used))
        assert all(d[a : a + n] == i[b : b + n] for a, b, n in t)


@pytest.mark.parametrize("limit", [1 << 24, 1])
def test_documents(spark, limit):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [
        (1, "Intro. " + item + " end"), (2, "a " + " ".join(f"W{i}," for i in range(5, 17))), (3, " ".join(f"w{i}" for i in range(11))), (4, None), (5, ""), (None, item),
        (6, "<p>" + item.replace(" ", "<br>") + "</p>"), (7, " ".join([f"w{i}" for i in range(15, 30)] + ["x"] + [f"w{i}" for i in range(15)])), (8, "b " * 20_000 + item), (1, "Intro. " + item + " end"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as id", "3 as seed")
    t = spark.createDataFrame([(10, item), (10, item), (11, "too short"), (12, None), (None, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaked_items(d, t, filter_bytes=limit).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 10), (7, 10), (8, 10)}
    assert got[7, 10]["tiles"] == 2 and got[7, 10]["coverage"] == 1.0 and got[2, 10]["covered"] == 12
    assert leaked_items(d.limit(0), t, filter_bytes=limit).count() == leaked_items(d, t.limit(0), filter_bytes=limit).count() == 0
    assert [tuple(r) for r in leak_report(d, t).collect()] == [(10, 5, 4, 1.0)]


def test_filter_keeps_all_it_was_built_of(spark):
    rnd = np.random.default_rng(3)
    keys, others = rnd.integers(0, 2**64, (2, 3000), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in keys.view(np.int64)] + [(None,)], "key long")
    for most in (1 << 20, 64):
        f = bloom_filter(df, "key", most)
        assert f.passes(keys).all() and 64 <= 8 * len(f.bits.value) <= max(most, 1 << 13)
    assert bloom_filter(df, "key").passes(others).mean() < 0.02
    assert not bloom_filter(df.limit(0), "key").passes(others).any()


def test_a_passage_that_many_share(spark):
    """A boilerplate passage in many items and documents: every pair is a case, each once."""
    common = " ".join(f"c{i}" for i in range(14))
    docs = spark.createDataFrame([(i, f"d{i} {common} {common} end") for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"t{i} {common}") for i in range(25)], "item_id long, text string")
    got = leaked_items(docs, items).collect()
    assert len(got) == 60 * 25 and {(r["tiles"], r["covered"], r["item_words"]) for r in got} == {(1, 14, 15)}
