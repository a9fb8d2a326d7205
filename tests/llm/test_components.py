import random

import pytest

from weftline.llm.components import hash_to_min, hook_and_shortcut
from weftline.llm.designs import design_groups
from weftline.operators.graph import connected_components


def brute(edges):
    low = {}

    def find(x):
        low.setdefault(x, x)
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            low[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(low)}


def cases():
    rnd = random.Random(5)
    yield []
    yield [(1, 1), (None, 2), (3, None)]
    yield [(i, i + 1) for i in range(40)]  # a chain
    yield [(0, i) for i in range(1, 300)] + [(500, 501)]  # a hot vertex
    yield [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] * 2


OPS = [
    lambda e: {r["vertex"]: r["group_id"] for r in hash_to_min(e, "a", "b").collect()},
    lambda e: {r["vertex"]: r["group_id"] for r in hook_and_shortcut(e, "a", "b").collect()},
    lambda e: {r["vertex"]: r["component"] for r in connected_components(e, "a", "b").collect()},
]


@pytest.mark.parametrize("op", range(3))
def test_against_brute_force(spark, op):
    shift = lambda x, k: None if x is None else x + 1000 * k
    edges = [(shift(a, k), shift(b, k)) for k, c in enumerate(cases()) for a, b in c]  # all cases beside each other
    df = spark.createDataFrame(edges, "a long, b long").selectExpr("a", "b", "1 as vertex", "2 as u", "3 as v")
    assert OPS[op](df) == brute(edges)
    assert OPS[op](df.limit(0)) == {}


def test_vertices_without_links(spark):
    e = spark.createDataFrame([("b", "a")], "a string, b string")
    v = spark.createDataFrame([("b",), ("z",), (None,)], "x string")
    assert {tuple(r) for r in hook_and_shortcut(e, "a", "b", v).collect()} == {("a", "a"), ("b", "a"), ("z", "z")}


def test_design_spellings_and_verdicts(spark):
    rows = [("Плащ  Ёлка ", "плащ елка", "same"), ("плащ ЕЛКА", "юбка", "same"), ("юбка", "топ", "different"), ("юбка", None, "same"), ("юбка", " ", "same"), ("a", "b", None), ("Б В", "б в", "same")]
    df = spark.createDataFrame(rows, "design_a string, design_b string, verdict string")
    assert {tuple(r) for r in design_groups(df).collect()} == {("плащ елка", "плащ елка"), ("юбка", "плащ елка")}
