import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftmill.llm import components
from siftmill.llm.components import clean_links, connected_groups
from siftmill.operators import graph


@pytest.fixture(params=[0, 1_000_000], ids=["rounds", "one task"], autouse=True)
def where(request, monkeypatch):
    """Every test runs with the distributed rounds and with cores that one task contracts."""
    for module in (graph, components):
        monkeypatch.setattr(module, "ONE_TASK_EDGES", request.param)


def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


def groups(spark, pairs):
    df = spark.createDataFrame(pairs, "x long, y long")
    return {r.file_id: r.group_id for r in connected_groups(clean_links(df, F.col("x"), F.col("y"), F.lit(True))).collect()}


def test_shapes(spark):
    r = random.Random(4)
    ids = r.sample(range(10**6), 900)
    pairs = [(ids[i], ids[i + 1]) for i in range(130)]  # chain
    pairs += [(ids[200 + i], ids[200 + (i + 1) % 37]) for i in range(37)]  # cycle
    pairs += [(ids[300 + i], ids[300 + (i + 1) % 3]) for i in range(3)]  # triangle
    pairs += [(ids[400], ids[401 + i]) for i in range(90)]  # star
    pairs += [(ids[500 + a], ids[500 + b]) for a in range(7) for b in range(a)]  # clique
    pairs += [(ids[506], ids[520]), (ids[520], ids[521]), (ids[521], ids[500])]  # chain with both ends in it
    pairs += [(ids[600 + r.randrange(200)], ids[600 + r.randrange(200)]) for _ in range(190)]
    pairs = [p for p in pairs if p[0] != p[1]]
    assert groups(spark, pairs + [(b, a) for a, b in pairs[:50]]) == union_find(pairs)


def test_few(spark):
    assert groups(spark, []) == {}
    assert groups(spark, [(5, 3), (3, 5), (7, 7), (None, 1), (1, None)]) == {3: 3, 5: 3}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)).filter(lambda p: p[0] != p[1]), min_size=1, max_size=40))
def test_any_graph(spark, pairs):
    assert groups(spark, pairs) == union_find(pairs)


def test_hubs_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "hot_limit", lambda rows: 8)
    pairs = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 59)] + [(100 + i, 100 + (i * 7) % 41) for i in range(1, 41)] + [(100, 130)]
    assert groups(spark, [p for p in pairs if p[0] != p[1]]) == union_find([p for p in pairs if p[0] != p[1]])


def test_links_are_filtered(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (2, 3, 1.0), (3, 4, 0.49), (4, 5, 1.01), (5, 6, float("nan")), (6, 7, None)], "x long, y long, similarity double")
    keep = F.col("similarity").between(0.5, 1.0) & ~F.isnan("similarity")
    assert sorted(tuple(r) for r in clean_links(df, F.col("x"), F.col("y"), keep).collect()) == [(1, 2), (2, 3)]


def test_unfinished_work_is_an_error(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(0, 200)]
    monkeypatch.setattr(components, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        groups(spark, pairs + [(0, 200), (7, 500), (7, 501)])
