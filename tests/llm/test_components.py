import random

import pytest

from factloom.llm import components

SCHEMA = "fact_id_a string, fact_id_b string, relationship_type string, u int, root string"


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_groups(spark):
    rows = [("b", "a", "corroborates"), ("a", "b", "CORROBORATES"), ("b", "c", " Corroborates.\n"), ("d", "e", '"corroborates"'), ("e", "f", "RelationshipType.CORROBORATES"), ("c", "d", "contradicts (earlier corroborates)"), ("g", "h", "uncorroborated"), ("i", "i", "corroborates"), ("j", None, "corroborates"), (None, "j", "corroborates"), (" ", "j", "corroborates"), ("k", "l", None), ("m", "n", "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert {r.fact_id: r.group_id for r in components.corroboration_groups(df).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}
    assert components.corroboration_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_chains_and_hubs(spark, seed, monkeypatch):
    monkeypatch.setattr(components, "LEAST_HUB_DEGREE", 5)
    monkeypatch.setattr(components, "HUBS", 4)
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(80):03}", f"n{rng.randrange(80):03}") for _ in range(50)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("hub", f"h{i:03}") for i in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r.member: r.root for r in components.star_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == brute(edges)
    named = {r.member: r.root for r in components.named_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert named == got
