"""Components and first-wins against one decision after another."""

import random

import pytest

from sievecrest.operators import components as C


def one_by_one(edges):
    earlier = {}
    for later, e in edges:
        earlier.setdefault(later, set()).add(e)
    dropped = set()
    for later in sorted(earlier):
        if earlier[later] - dropped:
            dropped.add(later)
    return dropped


def edge_table(spark, edges, kind="bigint"):
    return spark.createDataFrame(edges, f"later {kind}, earlier {kind}")


def random_edges(seed, n=120, m=160):
    rnd = random.Random(seed)
    return [(max(p), min(p)) for p in (rnd.sample(range(n), 2) for _ in range(m))]


def test_roots_are_least_nodes(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(500 + i, 500) for i in range(300)]
    got, _ = C.component_roots(edge_table(spark, edges), "later", "earlier")
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    rows = got.collect()
    assert {r.node: r.root for r in rows} == root and len(rows) == len(root)


@pytest.mark.parametrize("limit", [1 << 18, 4])
def test_first_wins_equals_one_by_one(spark, limit):
    edges = [(a + 1000 * seed, b + 1000 * seed) for seed, m in ((1, 60), (2, 160), (3, 600)) for a, b in random_edges(seed, m=m) * 2]
    got = [r.idx for r in C.first_wins(edge_table(spark, edges), limit)[0].collect()]
    assert sorted(got) == sorted(one_by_one(edges))


def test_large_components_by_rounds(spark):
    """Stars, ladders, both signs from one head, and chains with branches."""
    star = [(i, 0) for i in range(1, 50)]
    ladder = [e for i in range(100, 140) for e in ((i + 1, i), (i + 2, i))]
    split = [(201, 200), (202, 201), (203, 200), (203, 202), (204, 203), (205, 201), (205, 202)]
    edges = star + ladder + split + [(a + 1000, b + 1000) for a, b in random_edges(9)]
    got, _ = C.settle_large(edge_table(spark, edges))
    assert sorted(r.idx for r in got.collect()) == sorted(one_by_one(edges))


@pytest.mark.parametrize("way", ["components", "rounds"])
def test_long_chains_take_few_rounds(spark, way):
    edges = [(i + 1, i) for i in range(10_000)]
    table = edge_table(spark, edges)
    got, rounds = C.first_wins(table) if way == "components" else C.settle_large(table)
    assert rounds < 20 and {r.idx for r in got.collect()} == set(range(1, 10_001, 2))


def test_names_and_nothing(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "c")]
    assert sorted(r.idx for r in C.first_wins(edge_table(spark, edges, "string"))[0].collect()) == ["b", "d"]
    assert C.first_wins(edge_table(spark, []))[0].count() == 0
