import itertools
import random

import pytest

from weftline.llm.splits import assign_splits, broken_groups, closest_splits, closest_subset

ITEMS = "sku_id string, design_id string, split string"
LINKS = "design_a string, design_b string, verdict string"


def reach(sizes, target):
    best = None
    for take in itertools.product(*[range(c + 1) for c in sizes.values()]):
        total = sum(s * k for s, k in zip(sizes, take))
        key = (abs(total - target), total)
        best = min(best, key) if best else key
    return best[1]


@pytest.mark.parametrize("seed", range(30))
def test_closest_subset_is_optimal(seed):
    rnd = random.Random(seed)
    sizes = {rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(rnd.randint(0, 5))}
    target = rnd.randint(0, 120)
    take = closest_subset(sizes, target)
    assert all(0 <= k <= sizes[s] for s, k in take.items())
    assert sum(s * k for s, k in take.items()) == (reach(sizes, target) if sizes else 0)


@pytest.mark.parametrize("seed", range(20))
def test_closest_subset_is_optimal_without_single_items(seed):
    rnd = random.Random(seed)
    unit = rnd.choice([1, 3, 10])
    sizes = {unit * rnd.randint(7, 60): rnd.randint(1, 6) for _ in range(rnd.randint(1, 5))}
    target = rnd.randint(0, 400)
    take = closest_subset(sizes, target)
    assert all(0 <= k <= sizes[s] for s, k in take.items())
    assert sum(s * k for s, k in take.items()) == reach(sizes, target)


def test_few_large_groups_come_as_near_as_they_can():
    assert sum(s * k for s, k in closest_subset({7: 10, 10: 3}, 61).items()) == 62
    scale = 10**8  # the same groups, counted in another unit: the optimum doesn't depend on size
    assert closest_subset({7 * scale: 10, 10 * scale: 3}, 61 * scale) == {s * scale: k for s, k in closest_subset({7: 10, 10: 3}, 61).items()}
    sizes = {999_983: 30, 1_000_003: 25, 500_009: 3}
    total = sum(s * k for s, k in closest_subset(sizes, 20_000_000).items())
    assert total == reach(sizes, 20_000_000)


def test_orders_of_the_splits_are_tried():
    plan = dict(closest_splits({6: 1, 4: 1, 3: 2, 5: 1}, {"val": 9, "test": 12}))
    totals = {n: sum(s * k for s, k in t.items()) for n, t in plan.items()}
    assert totals == {"val": 9, "test": 12}
    assert sum(t.get(3, 0) for t in plan.values()) <= 2


def test_groups_stay_together_near_the_shares(spark):
    items = [(f"i{i}", f"d{i % 300}", None) for i in range(900)] + [(f"h{i}", "hot", "train") for i in range(500)] + [("x", None, "val"), (None, "d1", "val"), ("i1", "d1", None)]
    links = [("D1", "d2 ", "same"), ("d2", "d3", "same"), ("d4", "d5", "different")]
    df = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 as size", "2 as at", "3 as item")
    rows = assign_splits(df, spark.createDataFrame(links, LINKS)).collect()
    assert len(rows) == 1401 and len({r["sku_id"] for r in rows}) == 1401
    by = {}
    for r in rows:
        by.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by.values())
    assert {r["group_id"] for r in rows if r["sku_id"] in ("i1", "i2", "i3")} == {"d1"}
    n = {s: sum(r["split"] == s for r in rows) for s in ("train", "val", "test")}
    assert n["val"] == n["test"] == 210 and by["hot"] == {"train"}
    assert {tuple(r) for r in assign_splits(df, spark.createDataFrame(links, LINKS)).collect()} == {tuple(r) for r in rows}


def test_broken_groups(spark):
    items = [("a", "p", "train"), ("b", "q", " Train"), ("c", "r", "val"), ("d", "s", None), ("e", "t", "val"), ("f", "t", "test"), ("g", None, "test")]
    links = [("p", "q", "same"), ("q", "r", "same")]
    df = spark.createDataFrame(items, ITEMS)
    assert {r[0] for r in broken_groups(df, spark.createDataFrame(links, LINKS)).collect()} == {"p", "t"}
    assert broken_groups(df.limit(0), spark.createDataFrame([], LINKS)).count() == 0
    assert assign_splits(df.limit(0), spark.createDataFrame([], LINKS)).count() == 0
