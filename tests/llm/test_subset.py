from collections import Counter
from itertools import product

import numpy as np
import pytest

from weftline.llm import subset
from weftline.llm.subset import full_turns, pivoted_rows

SCHEMA = "pair_id string, sku_id string, category_group string"


def varied_subset(df, k=None, **kw):
    return subset.varied_subset(df, k, split=None, **kw)


def plain_pivots(a, k, floor=1 - 1e-6):
    """Pivots of a QR of explicit feature rows."""
    r, out = a.copy(), []
    for _ in range(k):
        left = (r * r).sum(1)
        left[out] = -1
        p = int(np.argmax(left > left.max() - 1e-9))
        if left[p] < floor:
            break
        out.append(p)
        q = r[p] / np.linalg.norm(r[p])
        r = r - np.outer(r @ q, q)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_pivots_are_those_of_a_qr_of_the_rows(seed):
    rnd = np.random.default_rng(seed)
    item, room = rnd.integers(0, 25, 60), rnd.integers(0, 5, 60)
    w = 0.5 / (1 + rnd.integers(0, 4, 5))
    a = np.zeros((60, 30))
    a[np.arange(60), item] = 1
    a[np.arange(60), 25 + room] = np.sqrt(w[room])
    assert pivoted_rows(item, room, w[room], 40).tolist() == plain_pivots(a, 40)
    got = pivoted_rows(item, room, w[room], 40)
    assert sorted(item[got]) == sorted(set(item))
    assert pivoted_rows(item[:0], room[:0], w[room][:0], 3).tolist() == []


def test_deflated_weight_is_what_projection_leaves():
    """The residual of a new row of a room after m of its rows were projected out is that of a row with the shrunk weight."""
    for m, w in product((1, 3, 10), (0.5, 0.2)):
        c = np.hstack([np.eye(m), np.full((m, 1), np.sqrt(w))])
        q, _ = np.linalg.qr(np.hstack([c, np.zeros((m, 1))]).T)
        x = np.r_[np.zeros(m), np.sqrt(w), 1.0]
        assert np.isclose(((x - q @ (q.T @ x)) ** 2).sum(), 1 + w / (1 + m * w))


def test_full_turns():
    for counts, k in product(({1: 3, 4: 2}, {5: 4}, {1: 1, 2: 1, 9: 1}), range(1, 30)):
        given = lambda t: sum(min(n, t) * c for n, c in counts.items())  # noqa: B023, E731
        top = max(counts)
        assert full_turns(counts, k) == max(t for t in range(top + 1) if given(t) <= k)


def test_items_and_groups_are_spread(spark):
    rows = [(f"h{i}", "hot", "upper") for i in range(3000)] + [(f"u{i}", f"u{i % 200}", "Upper ") for i in range(600)] + [(f"l{i}", f"l{i}", "lower") for i in range(30)] + [(f"d{i}", f"d{i % 3}", "dress") for i in range(9)]
    rows += [("n1", "u1", None), ("n2", "u2", " "), ("x", None, None), (None, "u1", "upper"), ("h1", "hot", "upper")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as class", "2 as item", "3 as room", "4 as key", "5 as q", "6 as h")
    got = varied_subset(df, 120).collect()
    assert len(got) == len({r["pair_id"] for r in got}) == 120
    assert max(Counter(r["sku_id"] for r in got).values()) == 1
    n = Counter(r["category_group"] for r in got)
    assert n["lower"] == 30 and n["dress"] == 3 and n[None] == 1
    assert sorted(map(str, varied_subset(df, 120).collect())) == sorted(map(str, got))


def test_more_than_items(spark):
    rows = [(f"p{i}", f"s{i % 4}", "g") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = varied_subset(df, 10).collect()
    assert sorted(Counter(r["sku_id"] for r in got).values()) == [2, 2, 3, 3]
    assert {r["pair_id"] for r in varied_subset(df, 99).collect()} == {r[0] for r in rows}
    assert varied_subset(df, 0).count() == varied_subset(df.limit(0), 5).count() == 0


def test_each_of_many_uneven_groups_is_present(spark):
    rows = [(f"b{i}", f"b{i}", "g0") for i in range(1500)] + [(f"s{g}", f"s{g}", f"g{g}") for g in range(1, 200)]
    got = varied_subset(spark.createDataFrame(rows, SCHEMA), 210).collect()
    n = Counter(r["category_group"] for r in got)
    assert len(got) == len({r["sku_id"] for r in got}) == 210
    assert len(n) == 200 and n["g0"] == 11


@pytest.mark.parametrize("groups, items", [(100, 40), (1000, 3)])
def test_all_of_many_groups_are_present(spark, groups, items):
    rows = [(f"{g}-{i}", f"{g}-{i}", f"g{g}") for g in range(groups) for i in range(items)]
    got = varied_subset(spark.createDataFrame(rows, SCHEMA), share=3 * groups / len(rows)).collect()
    n = Counter(r["category_group"] for r in got)
    assert len(got) == 3 * groups and len(n) == groups and set(n.values()) == {3}


def test_shards_choose_exactly_as_many_and_evenly(spark, monkeypatch):
    monkeypatch.setattr(subset, "ROUND", 8)
    monkeypatch.setattr(subset, "NODE", 64)
    rows = [(f"{g}-{i}", f"{g}-{i}", f"g{g}") for g in range(4) for i in range((600, 300, 40, 5)[g])] + [(f"hot{i}", "hot", "g0") for i in range(500)]
    got = varied_subset(spark.createDataFrame(rows, SCHEMA), 301).collect()
    n = Counter(r["category_group"] for r in got)
    assert len(got) == len({r["sku_id"] for r in got}) == 301
    assert n["g3"] == 5 and n["g2"] == 40 and abs(n["g0"] - n["g1"]) <= 40


def test_records_beyond_all_items_are_even(spark):
    rows = [(f"a{i}", "a", f"g{i % 3}") for i in range(90)] + [(f"b{i}", "b", "g0" if i else None) for i in range(4)] + [("c", "c", "g1")]
    got = varied_subset(spark.createDataFrame(rows, SCHEMA), 14).collect()
    n = Counter(r["sku_id"] for r in got)
    assert n == {"a": 9, "b": 4, "c": 1}
    assert sorted(Counter(r["category_group"] for r in got if r["sku_id"] == "a").values()) == [3, 3, 3]
    three = varied_subset(spark.createDataFrame(rows, SCHEMA), 7).collect()
    assert Counter(r["sku_id"] for r in three) == {"a": 3, "b": 3, "c": 1} and all(r["category_group"] for r in three)


def test_only_the_split_is_chosen_from(spark):
    rows = [(f"p{i}", f"s{i}", "g", (" Train", "val", "test", None)[i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA + ", split string")
    assert {r["pair_id"] for r in subset.varied_subset(df, 99).collect()} == {f"p{i}" for i in range(0, 40, 4)}


def test_ranks_are_limited_before_the_shuffle(spark):
    rows = [(f"p{i}", f"s{i % 7}", "g") for i in range(100)]
    plan = varied_subset(spark.createDataFrame(rows, SCHEMA), 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
